"""The queries of this package in DuckDB SQL."""

from __future__ import annotations

from lumenledger.functions.image_metrics import lanczos_weights
from lumenledger.sources.ledger import IMAGE_COLUMNS, USER_COLUMNS


def _cte() -> str:
    users = ", ".join(f"{e} as {c}" for c, e in USER_COLUMNS.items())
    images = ", ".join(f"{e} as {c}" for c, e in IMAGE_COLUMNS.items())
    return f"with users as (select {users} from customer), images as (select {images} from orders)"


def _measures(prefix: str = "") -> str:
    return f"""count({prefix}id)::bigint as total_images,
      count(*) filter (where status = 'completed')::bigint as completed,
      count(*) filter (where status = 'failed')::bigint as failed,
      count(*) filter (where status in ('pending', 'processing'))::bigint as pending,
      floor(nullif(avg(ssim_score) filter (where status = 'completed'), 0e0) * 1e4 + 0.5e0) / 1e4 as avg_ssim,
      floor(nullif(avg(psnr_score) filter (where status = 'completed'), 0e0) * 1e2 + 0.5e0) / 1e2 as avg_psnr,
      coalesce(sum(original_size_bytes::bigint) filter (where status = 'completed'), 0)::bigint as total_original_bytes,
      coalesce(sum(protected_size_bytes::bigint) filter (where status = 'completed'), 0)::bigint as total_protected_bytes,
      coalesce(sum(processing_time_ms::bigint) filter (where status = 'completed'), 0)::bigint as total_processing_time_ms"""


def six(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


CTE = _cte()
#: Columns of an image in a list.
LISTED = """id, original_filename, status, protection_strength, width, height, original_size_bytes, protected_size_bytes,
  ssim_score, psnr_score, epsilon_used, processing_time_ms, error_message, vault_sealed, created_at"""
EXTENSION = "case when strpos(original_filename, '.') > 0 then lower(string_split(original_filename, '.')[-1]) else 'unknown' end"
BASE = """case when original_filename like '_%.%' then
  left(original_filename, length(original_filename) - strpos(reverse(original_filename), '.')) else original_filename end"""
ONE = "(select embedding::double[] from embeddings where vec_id = 3)"
E = "embedding::double[]"
APART = "(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::int"


#: Two sums over all components of v, the second weighted by place.
DIGEST = f"{six('list_sum(v)')} as total, floor(list_sum(list_transform(v, lambda x, i: x * i)) * 1e4 + 0.5e0) / 1e4 as placed"


#: Vectors as gray images of 8 x 8: id, k (place), p (byte).
PLANES = """px as (select vec_id as id, k, least(greatest(floor((embedding[k + 1]::double + 0.5e0) * 255e0), 0), 255)::bigint as p
    from (select vec_id, embedding, unnest(range(64)) as k from embeddings where len(embedding) = 64))"""
#: Three vectors in a row as the channels of an image, and the same from a vector later on.
_CHANNELS = "max(case when {at} % 3 = 0 then p end) as b, max(case when {at} % 3 = 1 then p end) as g, max(case when {at} % 3 = 2 then p end) as r"
_WOVEN = "select {at} // 3 as id, k, {c} from px where {at} >= 0 group by all having count(*) = 3"
COLOURS = f"{PLANES}, colour as ({_WOVEN.format(at='px.id', c=_CHANNELS.format(at='px.id'))}), later as ({_WOVEN.format(at='(px.id - 1)', c=_CHANNELS.format(at='(px.id - 1)'))})"
SUMS = f"{six('sum(x)')} as total, floor(sum(x * (k + 1)) * 1e4 + 0.5e0) / 1e4 as placed"
NEAR = "bit_count(xor(('0x' || a.phash)::ubigint, ('0x' || b.phash)::ubigint))"


def hashed(source: str, name: str, side: int = 8, crops: bool = True) -> str:
    """Tables that end in ``name`` (id, place, hash_kind, phash) for images of ``side`` x ``side`` (id, k, p): two products with whole cosine weights, and the median."""
    from lumenledger.functions.perceptual import CROPS, FULL, basis

    cut = int(side * 0.75)
    kinds = [(FULL, 0, 0, 0, side)] + [(c, i + 1, int(side * t), int(side * left), cut) for i, (c, (t, left, _, _)) in enumerate(CROPS.items()) if crops]
    kind_rows = ", ".join(f"('{c}', {i}, {t}, {left}, {n})" for c, i, t, left, n in kinds)
    weights = ", ".join(f"({n}, {u}, {i}, {int(w)})" for n in (cut, side) for u, row in enumerate(basis(n)) for i, w in enumerate(row))
    return f"""{name}_k(hash_kind, place, t, l, n) as (values {kind_rows}), {name}_w(n, u, i, w) as (values {weights}), {name}_1 as (
      select id, hash_kind, place, c.n, u, k % {side} - l as j, sum(w.w * p)::bigint as s from {source} px
      join {name}_k c on k // {side} between t and t + c.n - 1 and k % {side} between l and l + c.n - 1 join {name}_w w on w.n = c.n and w.i = k // {side} - t group by all
    ), {name}_2 as (
      select id, hash_kind, place, a.u * 8 + w.u as spot, sum(s * w.w)::bigint as c from {name}_1 a join {name}_w w on w.n = a.n and w.i = a.j group by all
    ), {name}_3 as (
      select *, row_number() over (partition by id, place order by c) as r from {name}_2
    ), {name}_4 as (
      select *, sum(case when r in (32, 33) then c else 0 end) over (partition by id, place) as middle from {name}_3
    ), {name}_5 as (
      select id, place, hash_kind, lower(lpad(hex(sum(case when 2 * c > middle then 1::ubigint << (63 - spot) else 0 end)::ubigint), 16, '0')) as phash from {name}_4 group by all
    ), {name} as (
      select id, place::int as place, hash_kind, phash from {name}_5 qualify row_number() over (partition by id, phash order by place) = 1
    )"""


#: Four images of every vector (plain, brighter, of less contrast, and a copy), the halves of their hashes, and a row for each hash.
HASHES = f"""edit as (
    select vec_id * 4 + e as id, k, least(greatest(floor((case e when 1 then c + {12 / 255!r}::double when 2 then c * 0.8e0 else c end + 0.5e0) * 255e0), 0), 255)::bigint as p
    from (select vec_id, e, k, embedding[k + 1]::double as c from (select vec_id, embedding, unnest(range(64)) as k from embeddings where len(embedding) = 64), (values (0), (1), (2), (3)) v(e))
  ), {hashed("edit", "whole", crops=False)}, h as (select id, ('0x' || phash[1:8])::bigint as hi, ('0x' || phash[9:16])::bigint as lo from whole),
  r as (select min(id) as id, hi, lo from h group by hi, lo)"""


def _pairs(most: int) -> str:
    return f"with {HASHES} select a.id as a_id, b.id as b_id, {APART} as distance from r a join r b on a.id < b.id and {APART} <= {most}"


def similar(pair: str, key: str) -> str:
    """A table sim (key, ssim) over pairs of planes (key, k, x, y) of 8 x 8: windows of 7 x 7."""
    return f"""win as (select i, j from (values (0), (1)) s(i), (values (0), (1)) t(j)), mom as (
      select {key}, avg(x) as mx, avg(y) as my, 49e0 / 48e0 * (avg(x * x) - avg(x) * avg(x)) as vx, 49e0 / 48e0 * (avg(y * y) - avg(y) * avg(y)) as vy,
        49e0 / 48e0 * (avg(x * y) - avg(x) * avg(y)) as vxy
      from {pair} join win on k // 8 between i and i + 6 and k % 8 between j and j + 6 group by {key}, i, j
    ), sim as (
      select {key}, avg((2 * mx * my + 6.5025e0) * (2 * vxy + 58.5225e0) / ((mx * mx + my * my + 6.5025e0) * (vx + vy + 58.5225e0))) as ssim from mom group by {key}
    )"""


def bilinear_weights(n: int, m: int) -> list[list[float]]:
    """What each of n pixels gives to each of m: two neighbours by distance, centres at half steps."""
    out = [[0.0] * n for _ in range(m)]
    for i in range(m):
        at = max((i + 0.5) * n / m - 0.5, 0)
        low = min(int(at), n - 1)
        out[i][low] += 1 - (at - low)
        out[i][min(low + 1, n - 1)] += at - low
    return out


def resampled(weights) -> str:
    """Planes of 8 x 8 taken to 5 x 12 by a table of weights along each side."""
    rows = ", ".join(f"('{side}', {i}, {j}, {float(w)!r}::double)" for side, m in (("y", 5), ("x", 12)) for i, row in enumerate(weights(8, m)) for j, w in enumerate(row))
    return f"""with {PLANES}, w(side, i, j, w) as (values {rows}), a as (
          select id, w.i as i, k % 8 as x, sum(w.w * p) as s from px join w on side = 'y' and w.j = k // 8 group by all
        ), v as (select id, a.i * 12 + w.i as k, sum(w.w * s) as x from a join w on side = 'x' and w.j = a.x group by all)
        select id, {SUMS} from v group by id"""


ORACLES: dict[str, str] = {
    "summary_one_user": f"{CTE} select {_measures()} from images where user_id = 7",
    "summary_all_users": f"{CTE} select u.id as user_id, {_measures('i.')} from users u left join images i on i.user_id = u.id group by u.id",
    "summary_idle_users": f"{CTE} select u.id as user_id, {_measures('i.')} from users u left join (select * from images where status = 'failed') i on i.user_id = u.id group by u.id",
    "status_breakdown": f"{CTE} select status, count(*)::bigint as n from images group by status",
    "image_count": f"{CTE} select count(*)::bigint as total from images where user_id = 7",
    "list_page": f"{CTE} select {LISTED} from images where user_id = 7 order by created_at desc, id desc limit 5",
    "list_page_past_end": f"{CTE} select {LISTED} from images where user_id = 7 order by created_at desc, id desc limit 20 offset 199980",
    "list_page_ties": f"{CTE} select id, status from images order by date_trunc('month', created_at) desc, id desc limit 20 offset 40",
    "list_page_all_users": f"""{CTE}, p as (select id, user_id, created_at, status,
        row_number() over (partition by user_id order by created_at desc, id desc)::int as position from images)
        select * from p where position between 4 and 6""",
    "list_response": f"""{CTE}, p as (select id, status, row_number() over (order by created_at desc, id desc) as n from images where user_id = 7)
        select count(*)::bigint as total, 0 as page, 4 as page_size, coalesce(string_agg(id || ':' || status, ',' order by n) filter (where n <= 4), '') as images from p""",
    "status_lookup": f"{CTE} select id, status, ssim_score, psnr_score, processing_time_ms, error_message, vault_sealed from images where id = 1",
    "download_resolve": f"""{CTE}, a as (select *, user_id + case when id % 5 = 0 then 1 else 0 end as asker,
          case when id % 5 = 0 then 'unknown' when status not in ('completed', 'failed') then 'not ready'
            when protected_path is null or id % 7 = 0 then 'missing' else 'found' end as outcome from images)
        select id as image_id, asker as user_id, outcome,
          case when outcome = 'found' then 'protected_' || {BASE} || case when vault_sealed then '.enc' else '.png' end end as file_name,
          case when outcome = 'found' then case when vault_sealed then 'application/octet-stream' else 'image/png' end end as media_type from a""",
    "image_by_owner": f"{CTE} select id, user_id, status from images where id = 2",
    "user_by_key": f"{CTE} select id, email, display_name, is_active, vault_salt from users where email = 'customer#000000007@example.com'",
    "active_users": f"{CTE} select id, display_name from users where is_active",
    "download_name": f"""{CTE} select id, 'protected_' || case when original_filename like '_%.%' then
        left(original_filename, length(original_filename) - strpos(reverse(original_filename), '.')) else original_filename end
        || case when vault_sealed then '.enc' else '.png' end as file_name,
        case when vault_sealed then 'application/octet-stream' else 'image/png' end as media_type
        from images where status in ('completed', 'failed')""",
    "existing_files": f"{CTE} select id from images where id in (select l_orderkey from lineitem where l_quantity < 3)",
    "json_response": f"""{CTE} select '{{"id":' || id || ',"email":"' || email || '","salt":' || case when vault_salt = '' then 'null' else '"' || vault_salt || '"' end || ',"is_active":' || is_active::varchar || '}}' as body from users""",
    "eager_load_semi": f"{CTE} select id, user_id, status from images where user_id in (select id from users where segment = 'BUILDING')",
    "image_with_owner": f"{CTE} select i.id, i.user_id, u.display_name as owner_display_name, u.is_active as owner_is_active from images i join users u on u.id = i.user_id",
    "images_nested": f"""{CTE} select u.id, count(i.id)::bigint as n_images, coalesce(string_agg(i.id::varchar, ',' order by i.id), '') as image_ids
        from users u left join (select * from images where status = 'failed') i on i.user_id = u.id group by u.id""",
    "orphan_images": f"{CTE} select id, user_id from images i where not exists (select 1 from users u where u.id = i.user_id and u.is_active)",
    "duplicate_keys": "select l_orderkey, l_linenumber, count(*)::bigint as n from lineitem group by 1, 2 having count(*) > 1",
    "register_user": f"{CTE} select id, email, display_name from users union all select -3, 'new@example.com', 'first'",
    "mark_processing": f"{CTE} select id, case when status = 'pending' and id % 4 = 0 then 'processing' else status end as status from images",
    "mark_failed": f"""{CTE} select id, case when hit then 'failed' else status end as status,
        case when hit then left(repeat('error ' || id || ';', 80), 500) else error_message end as error_message, processing_time_ms
        from (select *, status = 'processing' and id % 2 = 1 as hit from images)""",
    "persist_result": f"""{CTE} select id, case when status <> 'processing' then status when id % 7 = 0 then 'failed'
        when (90 + id % 10) / 100e0 < 0.95e0 then 'quality_warning' else 'completed' end as status,
        {six("case when status = 'processing' then (90 + id % 10) / 100e0 else ssim_score end")} as ssim_score,
        {six("case when status = 'processing' then 30.5e0 else psnr_score end")} as psnr_score,
        case when status = 'processing' then floor(original_size_bytes / 3)::int else protected_size_bytes end as protected_size_bytes,
        {six("case when status = 'processing' then 0.03125e0 else epsilon_used end")} as epsilon_used,
        case when status <> 'processing' then original_path end as original_path,
        case when status = 'processing' then 'store/' || id else protected_path end as protected_path from images""",
    "seal_vault": f"""{CTE}, x as (select *, user_id % 2 = 0 and not vault_sealed as hit from images) select id, status, vault_sealed or hit as vault_sealed,
        case when hit then original_size_bytes + 16 else protected_size_bytes end as protected_size_bytes,
        case when hit then 'vault/' || id else protected_path end as protected_path from x""",
    "backfill_salt": f"{CTE} select id, case when vault_salt = '' then sha256(id::varchar) else vault_salt end as vault_salt from users",
    "delete_one": f"{CTE} select id from images where id <> 3",  # 4 is asked for by another user
    "purge_user": f"{CTE} select id, user_id from images where user_id <> 7",
    "terminate_user": f"""{CTE} select u.id, count(i.id)::bigint as n_images from users u left join images i on i.user_id = u.id
        where u.is_active or u.segment <> 'MACHINERY' group by u.id""",
    "add_column_default": f"{CTE} select id, vault_sealed, case when id % 2 = 0 then 'w' || id else '' end as watermark_id, true as watermark_enabled from images",
    "upload_validity": f"""{CTE}, x as (select id, original_size_bytes as length, case when strpos(original_filename, '.') > 0
        then lower(string_split(original_filename, '.')[-1]) else 'unknown' end as extension from images)
        select id, extension, case when extension not in ('jpg', 'jpeg', 'png', 'webp') then 'extension'
        when length > 200000 then 'size' when length = 0 then 'empty' end as refused from x""",
    "upload_quarantine": f"""{CTE}, x as (select original_size_bytes as length, case when strpos(original_filename, '.') > 0
        then lower(string_split(original_filename, '.')[-1]) else 'unknown' end as extension from images)
        select case when extension not in ('jpg', 'jpeg', 'png', 'webp') then 'extension'
        when length > 200000 then 'size' when length = 0 then 'empty' else 'taken' end as refused, count(*)::bigint as n from x group by 1""",
    "upload_message": f"""{CTE}, x as (select id, {EXTENSION} as extension from images)
        select id, '.' || extension || ' is not allowed, only jpeg, jpg, png, webp' as message from x where extension not in ('jpg', 'jpeg', 'png', 'webp')""",
    "protect_chain": f"""{CTE}, x as (select id, id % 11 = 0 as broken, 0.9e0 + id % 10 / 100e0 as score from images
          where {EXTENSION} in ('jpg', 'jpeg', 'png', 'webp') and original_size_bytes between 1 and 200000)
        select id, case when broken then 'failed' when score < 0.95e0 then 'quality_warning' else 'completed' end as status,
          (id % 5000)::int as processing_time_ms, case when broken then 'no face' end as error_message, 0.5e0 as protection_strength, true as watermark_enabled from x""",
    "prefix_test": f"{CTE} select id, coalesce(protected_path like 'store/1%' or protected_path like 'store/3%', false) as stored from images",
    "upload_count_cap": f"""{CTE} select user_id || '/' || year(created_at) as request, count(*)::bigint as n_files from images group by 1 having count(*) > 4""",
    "extension_of": f"""{CTE} select id, case when strpos(original_filename, '.') > 0 then lower(string_split(original_filename, '.')[-1]) else 'unknown' end as extension,
        case when original_filename like '_%.%' then left(original_filename, length(original_filename) - strpos(reverse(original_filename), '.')) else original_filename end as base from images""",
    "cosine_to_query": f"select vec_id, {six(f'list_cosine_similarity({E}, {ONE})')} as cosine from embeddings",
    "cosine_topk": f"select vec_id, {six(f'list_cosine_similarity({E}, {ONE})')} as cosine from embeddings order by cosine desc, vec_id limit 10",
    "cosine_batch_mean": f"select label, {six(f'avg(list_cosine_similarity({E}, {ONE}))')} as mean_cosine, count(*)::bigint as n from embeddings group by label",
    "nearest_under_threshold": f"""select * from (select vec_id, {six(f'list_distance({E}, {ONE})')} as distance from embeddings where vec_id <> 3)
        where distance < 1.2e0 order by distance, vec_id limit 1""",
    "dynamic_weights": "with d as (select vec_id, " + ", ".join(f"1e0 - list_cosine_similarity({E}, (select {E} from embeddings where vec_id = {i})) as d{i}" for i in (3, 4, 5))
    + " from embeddings) select vec_id, " + ", ".join(f"{six(f'd{i} / (d3 + d4 + d5 + 1e-6)')} as w{i - 3}" for i in (3, 4, 5)) + " from d",
    "clamp_linf": f"""with x as (select vec_id, [least(greatest(least(greatest(p[1], p[2] - 0.03e0), p[2] + 0.03e0), 0e0), 1e0) for p in list_zip({E}, {ONE})] as v from embeddings)
        select vec_id, {DIGEST} from x""",
    "signed_step": f"""with x as (select vec_id, [p[1] - 2.5e0 * 0.0313e0 / 100e0 * sign(p[2]) for p in list_zip({E}, {ONE})] as v from embeddings)
        select vec_id, {DIGEST} from x""",
    "max_abs_diff": f"""with x as (select vec_id, list_max([abs(p[1] - p[2]) for p in list_zip({E}, {ONE})]) as s from embeddings)
        select vec_id, {six('s')} as shift, s <= ceil(0.25e0 * 255e0) / 255e0 + 1e-4 as within from x""",
    "channel_normalise": f"""with x as (select vec_id, list_transform(range(1, 64), lambda i: (embedding[i]::double - [0.406e0, 0.485e0, 0.456e0][i % 3 + 1])
          / [0.225e0, 0.229e0, 0.224e0][i % 3 + 1]) as v from embeddings where len(embedding) = 64) select vec_id, {DIGEST} from x""",
    "trace_sample": "select conv_id, turn from (select conv_id, turn, max(turn) over (partition by conv_id) as last from conversations) where turn % 10 = 0 or turn = last",
    "psnr_pairs": f"""with x as (select vec_id, list_sum([(p[1] - p[2]) * (p[1] - p[2]) * 65025e0 for p in list_zip({E}, {ONE})]) / len(embedding) as mse from embeddings)
        select vec_id, case when mse = 0 then 'infinity'::double else {six("10e0 * log10(65025e0 / nullif(mse, 0))")} end as psnr from x""",
    "ssim_pairs": f"""with e as (select vec_id, {E} as a, {ONE} as b from embeddings where len(embedding) = 64), p as (
          select vec_id, k // 8 as r, k % 8 as c, least(greatest(floor((a[k + 1] + 0.5e0) * 255e0), 0), 255) as x, least(greatest(floor((b[k + 1] + 0.5e0) * 255e0), 0), 255) as y
          from (select vec_id, a, b, unnest(range(64)) as k from e)
        ), w as (select i, j from (values (0), (1)) s(i), (values (0), (1)) t(j)), m as (
          select vec_id, avg(x) as mx, avg(y) as my, 49e0 / 48e0 * (avg(x * x) - avg(x) * avg(x)) as vx, 49e0 / 48e0 * (avg(y * y) - avg(y) * avg(y)) as vy,
            49e0 / 48e0 * (avg(x * y) - avg(x) * avg(y)) as vxy
          from p join w on r between i and i + 6 and c between j and j + 6 group by vec_id, i, j)
        select vec_id, {six("avg((2 * mx * my + 6.5025e0) * (2 * vxy + 58.5225e0) / ((mx * mx + my * my + 6.5025e0) * (vx + vy + 58.5225e0)))")} as ssim from m group by vec_id""",
    "job_outcomes": f"""{CTE} select id, case when id % 9 = 0 then 'failed' when ssim_score < 0.95e0 then 'quality_warning' else 'completed' end as status
        from images where ssim_score is not null""",
    "hash_shape": """select doc_id, regexp_full_match(case doc_id % 3 when 0 then upper(substr(md5(text), 1, 16)) when 1 then substr(md5(text), 1, 15)
        else substr(md5(text), 1, 16) end, '[0-9a-f]{16}') as well_formed from documents""",
    "hash_dedupe": """with e as (select doc_id as id, case when doc_id % 11 = 0 then ' ' else lang end as hash_kind,
        case when doc_id % 13 <> 0 then substr(md5(text), 1, 16) end as phash from documents)
        select hash_kind, phash, min(id) as id from e where trim(hash_kind) <> '' and phash is not null
        and (hash_kind, phash) not in (select (hash_kind, phash) from e where id < 20 and phash is not null) group by 1, 2""",
    "known_hashes": f"with {HASHES} select id from h where lo in (select lo from h where id % 10 = 0)",
    "known_by_bloom": f"with {HASHES} select id from h where lo in (select lo from h where id % 10 = 0)",
    "hash_candidates": """with c as (select doc_id, substr(md5(text), 1, 8) as a, substr(md5(text), 9, 8) as b, case when doc_id % 2 = 0 then substr(md5(text), 17, 8) end as c from documents)
        select doc_id, case when doc_id % 3 = 0 then concat_ws(',', a, c, b) else concat_ws(',', a, b, c) end as candidates from c""",
    "token_expiry": f"{CTE} select id, created_at + interval 90 minute as expires_at from images",
    "uuid_guard": f"""{CTE} select id, case when id % 4 <> 2 then substr(md5(id::varchar), 1, 8) || '-' || substr(md5(id::varchar), 9, 4) || '-'
        || substr(md5(id::varchar), 13, 4) || '-' || substr(md5(id::varchar), 17, 4) || '-' || substr(md5(id::varchar), 21, 12) end as uuid from users""",
    "hamming_pairs": _pairs(2),
    "hamming_banded": _pairs(4),
    "hamming_classes": f"with {HASHES} select h.id, r.id as class_id from h join r using (hi, lo)",
    "image_phash": f"with {PLANES}, {hashed('px', 'k0')} select id, place, hash_kind, phash from k0",
    "gray_planes": f"""with {COLOURS}, v as (select id, k, ((114 * b + 587 * g + 299 * r + 500) // 1000)::double as x from colour)
        select id, {SUMS} from v group by id""",
    "unit_planes": f"""with {COLOURS}, v as (select id, k, r::double as x from colour union all select id, 64 + k, g from colour union all select id, 128 + k, b from colour)
        select id, {SUMS} from v group by id""",
    "quality_colour": f"""with {COLOURS}, pair as (
          select id, ch, k, x, y from (select a.id, a.k, unnest([a.b, a.g, a.r]) as x, unnest([c.b, c.g, c.r]) as y, unnest([0, 1, 2]) as ch from colour a join later c using (id, k))
        ), {similar('pair', 'id, ch')}, s as (select id, avg(ssim) as ssim from sim group by id), m as (select id, avg((x - y) * (x - y)) as mse from pair group by id)
        select id, {six('ssim')} as ssim, case when mse = 0 then 'infinity'::double else {six("10e0 * log10(65025e0 / nullif(mse, 0))")} end as psnr from s join m using (id)""",
    "quality_unreadable": f"""with {PLANES}, pair as (select a.id, a.k, a.p::double as x, c.p::double as y from px a join px c on c.id = a.id + 1 and c.k = a.k), {similar('pair', 'id')},
        m as (select id, avg((x - y) * (x - y)) as mse from pair group by id)
        select id, case when id % 5 = 0 then 0 else {six('ssim')} end as ssim, case when id % 5 = 0 then 0 when mse = 0 then 'infinity'::double else {six("10e0 * log10(65025e0 / nullif(mse, 0))")} end as psnr
        from sim join m using (id)""",
    "bilinear_planes": resampled(bilinear_weights),
    "lanczos_planes": resampled(lanczos_weights),
    "benchmark_pairs": f"""with {COLOURS}, pair as (
          select id, ch, k, x, x // 16 * 15 as y from (select id, k, unnest([b, g, r]) as x, unnest([0, 1, 2]) as ch from colour)
        ), {similar('pair', 'id, ch')}, s as (select id, avg(ssim) as ssim from sim group by id), m as (select id, max(abs(x - y)) / 255e0 as shift from pair group by id)
        select id, {six('ssim')} as ssim, {six('shift')} as shift, shift <= ceil(0.1e0 * 255e0) / 255e0 + 1e-4 as within from s join m using (id)""",
    "image_files": f"""with {PLANES}, v as (select id, k, p::double as x from px)
        select id, 8 as width, 8 as height, 1 as channels, {SUMS}, true as held from v group by id""",
    "augment_boxes": f"""{CTE}, u as (
          select id, height, width, iteration, {", ".join(f"('0x' || substr(md5(id || ':' || iteration || ':{j}'), 1, 8))::bigint / 4294967296e0 as u{j}" for j in range(4))}
          from (select id, height, width, unnest([0, 1, 2])::int as iteration from images)
        ), b as (select *, greatest(1, floor(height * (0.8e0 + u0 * (1 - 0.8e0))))::int as box_height, greatest(1, floor(width * (0.8e0 + u0 * (1 - 0.8e0))))::int as box_width from u)
        select id, iteration, floor(u1 * (height - box_height + 1))::int as top, floor(u2 * (width - box_width + 1))::int as left, box_height, box_width,
          {six("0.1e0 + u3 * (1e0 - 0.1e0)")} as sigma from b""",
    "vector_range_search": f"""select a.vec_id as q_id, b.vec_id as id, {six("list_distance(a.embedding::double[], b.embedding::double[])")} as distance
        from embeddings a join embeddings b on a.vec_id % 20 = 0 and b.vec_id % 20 <> 0 where list_distance(a.embedding::double[], b.embedding::double[]) < 1.2e0""",
    "match_cascade": f"""with {PLANES}, {hashed("(select * from px where id % 20 <> 0)", "stored")}, shade as (
          select vec_id - 1 as id, k, least(greatest(floor((embedding[k + 1]::double + {20 / 255!r}::double + 0.5e0) * 255e0), 0), 255)::bigint as p
          from (select vec_id, embedding, unnest(range(64)) as k from embeddings where vec_id % 20 = 1) where (vec_id - 1) % 60 = 0
          union all
          select vec_id, k, least(greatest(floor((embedding[64 - k]::double + 0.5e0) * 255e0), 0), 255)::bigint from (select vec_id, embedding, unnest(range(64)) as k from embeddings where vec_id % 60 = 40)
        ), corner as (
          select id - 1 as id, (k // 8) * 6 + k % 8 as k, p from px where id % 20 = 1 and (id - 1) % 60 = 20 and k // 8 < 6 and k % 8 < 6
        ), {hashed("shade", "a8")}, {hashed("corner", "a6", 6)}, asked as (select * from a8 union all select * from a6), m as (
          select a.id as q_id, b.id, 0 as place, {NEAR}::double as distance, 'whole' as method from asked a join stored b on a.place = 0 and b.place = 0 and {NEAR} <= 6
          union all
          select a.id, b.id, 1, {NEAR}::double, 'region' from asked a join stored b on {NEAR} <= 2
          union all
          select a.vec_id, b.vec_id, 2, list_distance(a.embedding::double[], b.embedding::double[]), 'vector' from embeddings a join embeddings b on a.vec_id % 20 = 0 and b.vec_id % 20 <> 0
          where list_distance(a.embedding::double[], b.embedding::double[]) < 1.25e0)
        select q_id, id, floor(distance * 1e3 + 0.5e0) / 1e3 as distance, method from m qualify row_number() over (partition by q_id order by place, distance, id) = 1""",
    "queue_schedule": f"""{CTE}, j as (
          select user_id % 8 as lane, id, epoch_ms(created_at::date::timestamp)::bigint as submitted_ms, id % 30000000 as work_ms, ssim_score, error_message from images
        ), s as (
          select *, sum(work_ms) over w as total from j window w as (partition by lane order by submitted_ms, id rows unbounded preceding)
        ), e as (
          select *, total + max(submitted_ms - total + work_ms) over (partition by lane order by submitted_ms, id rows unbounded preceding) as ended from s
        )
        select lane, id, submitted_ms, (ended - work_ms)::bigint as begun_ms, ended::bigint as ended_ms, (ended - work_ms - submitted_ms)::bigint as waited_ms,
          case when error_message is not null then 'failed' when ssim_score < 0.95e0 then 'quality_warning' else 'completed' end as status from e""",
}
