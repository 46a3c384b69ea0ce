"""DuckDB SQL for the queries that SQL can express."""

OP6 = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by 1
)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when f.first_id is null or f.first_id = p.page_id then 'response' else 'revisit' end as record_type,
  case when f.first_id <> p.page_id then f.first_id end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""

OP10 = """
with l as (
  select doc_id, line, pos, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
      unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
    from documents
  )
), r as (
  select k, max(doc_id) as keeper from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), m as (
  select l.*, (r.k is not null and l.doc_id <> r.keeper) as gone from l left join r on l.k = r.k
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

OP1 = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws
  from documents
), s as (
  select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w
), n as (
  select doc_id, len(sh)::bigint as n_shingles from s
), e as (
  select doc_id, unnest(sh) as g from s
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), l as (
  select x, y from p join n as nx on nx.doc_id = x join n as ny on ny.doc_id = y where 100 * c >= 80 * (nx.n_shingles + ny.n_shingles - c)
), both_ways as (
  select x, y from l union all select y, x from l
), r(doc_id, root) as (
  select doc_id, doc_id from n union select r.doc_id, b.y from r join both_ways b on b.x = r.root
), m as (
  select doc_id, min(root) as component_id from r group by doc_id
)
select n.doc_id, n.n_shingles, m.component_id, m.component_id = n.doc_id as kept from n join m on m.doc_id = n.doc_id
"""

OP3 = """
with t as (
  select doc_id, encode(coalesce(text, '')) as b from documents
), s as (
  select doc_id, i, array_slice(b, i, i + 199) as k from (select doc_id, b, unnest(range(1, octet_length(b) - 198)) as i from t)
), again as (
  select doc_id, i from s semi join (select k from s group by k having count(*) > 1) using (k)
), marked as (
  select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as begins from again
), runs as (
  select doc_id, min(i) as a, max(i) + 199 as z
  from (select *, sum(begins) over (partition by doc_id order by i) as g from marked) group by doc_id, g
), gaps as (
  select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as a, a - 1 as z from runs
  union all select t.doc_id, coalesce(max(r.z), 0) + 1, octet_length(any_value(t.b)) from t left join runs r using (doc_id) group by t.doc_id
), kept as (
  select g.doc_id, string_agg(hex(array_slice(t.b, g.a, g.z)), '' order by g.a) as h from gaps g join t using (doc_id) where g.z >= g.a group by g.doc_id
), lost as (
  select doc_id, sum(z - a + 1)::bigint as n_removed, count(*)::bigint as n_spans from runs group by doc_id
)
select t.doc_id, octet_length(t.b)::bigint as n_bytes, coalesce(l.n_removed, 0)::bigint as n_removed, coalesce(l.n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(k.h, ''))) as kept_sha256
from t left join kept k using (doc_id) left join lost l using (doc_id)
"""

OP8 = """
with it as (
  select distinct item_id, w, least(5, len(w)) as k
  from (select item_id, regexp_extract_all(lower(text), '[0-9a-z\\x80-\\x{10FFFF}]+') as w from benchmark where text is not null) where len(w) > 0
), ish as (
  select item_id, k, s, count(*) as m
  from (select item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from it) group by all
), isz as (
  select item_id, k, sum(m) as n from ish group by all
), d as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x80-\\x{10FFFF}]+') as w from documents
), dsh as (
  select doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s, unnest(range(0, len(w) - k + 1)) as pos
  from d, (select distinct k from it) where len(w) >= k
), hit as (
  select doc_id, item_id, k, count(*) as c from dsh join ish using (k, s) group by all
), pair as (
  select doc_id, item_id, k, n, held, least(n, held) as width
  from hit join isz using (item_id, k) join (select doc_id, k, count(*) as held from dsh group by all) using (doc_id, k)
  where 1.8 * c >= 0.8 * (n + least(n, held))
), win as (
  select *, unnest(range(0, (held - width + 1)::bigint)) as start from pair
), both_have as (
  select doc_id, item_id, k, n, width, start, sum(least(x.m, ish.m)) as b
  from (
    select doc_id, item_id, k, n, width, start, s, count(*) as m
    from (select *, start + unnest(range(0, width::bigint)) as pos from win) join dsh using (doc_id, k, pos) group by all
  ) x join ish using (item_id, k, s) group by all
)
select doc_id, item_id, similarity, start::bigint as start, (width + k - 1)::bigint as n_words from (
  select *, row_number() over (partition by doc_id, item_id order by similarity desc, start) as place
  from (select *, b::double / (n + width - b) as similarity from both_have) where similarity >= 0.8
) where place = 1
"""

#: The polynomial of crc32, and the multipliers of the splitmix64 finaliser.
CRC_POLYNOMIAL = 0xEDB88320
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
TWO_64 = 1 << 64


def _mixed(x: int) -> int:
    for multiplier, shift in zip(MIX, (30, 27)):
        x = (x ^ x >> shift) * multiplier % TWO_64
    return x ^ x >> 31


def _crc32(b: str) -> str:
    """The unsigned checksum of the bytes ``b``, a byte at a time."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (CRC_POLYNOMIAL if byte & 1 else 0)
        table.append(byte)
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex({b}), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, x: xor(c >> 8, ([{', '.join(map(str, table))}]::bigint[])[(xor(c, x) & 255) + 1])))::bigint"""


def op7(shards: int = 8, seed: int = 20, rounds: int = 6) -> str:
    """Checksums a byte at a time, and the Feistel network a round at a time, until a value below the row count comes at a round's end."""
    keys = [_mixed((i * 0x9E3779B97F4A7C15 + seed) % TWO_64) for i in range(1, rounds + 1)]
    two64 = f"{TWO_64}::uhugeint"
    return f"""
with recursive d as (
  select doc_id, encode(coalesce(text, '')) as b from documents
), c as (
  select doc_id, octet_length(b)::bigint + 1 as size,
    {_crc32('b')} as text_crc32
  from d
), num as (
  select *, (row_number() over (order by doc_id nulls first, text_crc32, size) - 1)::ubigint as k, (count(*) over ())::ubigint as n from c
), dom as (
  select n, greatest(1, (ceil(log2(greatest(n, 2)))::int + 1) // 2) as half from num limit 1
), f(k, l, r, t) as (
  select num.k, num.k >> half, num.k & ((1::ubigint << half) - 1), 0 from num, dom
  union all
  select k, r, xor(l, xor(z, z >> 31) & ((1::ubigint << half) - 1)), t + 1 from (
    select *, (xor(y, y >> 27)::uhugeint * {MIX[1]} % {two64})::ubigint as z from (
      select *, (xor(w, w >> 30)::uhugeint * {MIX[0]} % {two64})::ubigint as y from (
        select f.*, half, ((r::uhugeint + ([{', '.join(map(str,keys))}]::uhugeint[])[t % {rounds} + 1]) % {two64})::ubigint as w
        from f, dom where not (t > 0 and t % {rounds} = 0 and (l << half) + r < n)
      )
    )
  )
), p as (
  select k, ((l << half) + r)::bigint as place from f, dom where t > 0 and t % {rounds} = 0 and (l << half) + r < n
)
select doc_id, size, text_crc32, 'rows' as law, (place % {shards})::int as shard, place // {shards} as slot, null::int as grown_shard from num join p using (k)
"""


OP11 = f"""
with recursive t as (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as r from documents) where length(r) >= 6
), h as (
  select r, c, {_crc32("encode(doc_id::varchar || ':' || r)")} as h from (select doc_id, r, count(*) as c from t group by all)
), w as (
  select case when h % 199 = 0 then r[1:(h % length(r))] || r[(h % length(r)) + 2:] else r end as word, sum(c)::bigint as n from h group by 1
), v as (
  select word, n from w where length(word) >= 6 and n >= 5
), d as (
  select word, i, word[1:i - 1] || word[i + 1:] as rest from (select word, unnest(range(1, length(word) + 1)) as i from v)
), near as (
  select a.word as a, b.word as b from d a join d b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select d.word, v.word from d join v on d.rest = v.word
  union select v.word, d.word from d join v on d.rest = v.word
), best as (
  select a, count(*) as n_near, min_by(b, (-v.n, b)) as b, max(v.n) as m from near join v on v.word = b group by a
), f as (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 5 * v.n then b end as form, case when m >= 5 * v.n then m end as form_n
  from v left join best on best.a = v.word
), r(word, root) as (
  select word, word from f union all select r.word, f.form from r join f on f.word = r.root where f.form is not null
), last as (
  select r.word, r.root from r join f on f.word = r.root where f.form is null
)
select word, form, root, n, n_near, form_n from f join last using (word)
"""


ORACLES = {"op11_spelling": OP11, "op1_minhash": OP1, "op3_repeats": OP3, "op6_warc": OP6, "op7_sharding": op7(), "op8_decontamination": OP8, "op10_line_dedup": OP10}
