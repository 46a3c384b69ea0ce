"""The document operators against brute force on small fixtures, and on odd rows."""

import bisect
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenledger.llm import common, decontaminate, line_dedup, minhash, packing, quality, repeats, sharding
from lumenledger.llm.common import discard, materialise, shared_dir
from lumenledger.llm.graph import components
from lumenledger.llm.oracle import ORACLES
from lumenledger.llm.segments import segments
from lumenledger.llm.shingles import SpanDigests

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, _text string, _id long, _key string, n_chars long"


def frame(spark, rows):
    """Documents with columns beside them whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "clash", 5, "clash", 0) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


#: Nulls, empty and blank texts, one word, repeated rows, an id with two texts, ties, a long text, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "ONE"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (8, "A b c d e f g h i j"),
    (9, "same id first text here now"), (9, "same id other text there then"), (None, "a b c d e f g h i j"), (None, "nobody else has this one text"),
    (10, "word " * 30_000), (11, "\x00 null byte ﻿ é́ 日本語 \U0001f600 \x1c x"), (12, "é" * 500), (-4, "x" * 450), (13, "x" * 450),
]


# ---- near-duplicates


def shingle_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, k):
    """doc_id -> smallest id linked, over ids that aren't null."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is None or j is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                low, high = sorted((root(i), root(j)))
                up[high] = low
    return {i: root(i) for i in up}


@pytest.mark.parametrize("block", [2 << 20, 1200])
def test_near_duplicates(spark, docs, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "STAND_INS", 1 if block == 1200 else 16)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau ups".split()
    rng = np.random.default_rng(4)
    chain = [words * 3]
    for _ in range(25):  # each a few edits from the one before: linked neighbours, ends far apart
        w = list(chain[-1])
        for p in rng.integers(0, len(w), 2):
            w[p] = f"n{rng.integers(10**6)}"
        chain.append(w)
    rows = docs[:120] + [(5000 + i, " ".join(w)) for i, w in enumerate(chain)]
    got = minhash.near_duplicates(frame(spark, rows), k=2).collect()
    want = brute_components(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingle_set(dict(rows)[r["doc_id"]], 2)) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_words_of_thue_and_morse_do_not_collide():
    """Strings whose polynomial hashes modulo 2**64 are equal, whatever the base."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [one.encode(), two.encode(), b"abc", b"abd", b"abcdefgh", b"abcdefghi", b"x" * 64, b"x" * 65, b"ABC"]
    sets = minhash.sets_of(np.frombuffer(b" ".join(texts), np.uint8), np.cumsum([0, *(len(t) + 1 for t in texts[:-1]), len(texts[-1])]), 2)
    assert len({s.tobytes() for s in sets}) == len(texts) - 1 and sets[2].tolist() == sets[8].tolist()
    raw = np.frombuffer((one + two)[:2048].encode(), np.uint8)
    whole = SpanDigests(raw).of(np.array([0, 1024, 0]), np.array([1024, 2048, 1023]))
    assert len(set(whole.tolist())) == 3


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(frame(spark, ODD), k=2).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert by[1] == {1} and by[2] == {2} and by[3] == {3} and by[4] == by[5] == by[6] == {4}
    assert by[7] == by[8] == {7} and by[9] == {9} and by[None] == {7, None} and by[13] == {-4}
    assert {r["kept"] for r in got if r["doc_id"] is None} == {True, False}
    assert minhash.near_duplicates(frame(spark, ODD).limit(0), k=2).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 10, 100, 5000):
        s = minhash.sketch(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (s != np.iinfo(np.uint64).max).all()
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 50).astype(np.uint64)])
    agree = np.mean([(minhash.sketch(a ^ np.uint64(s)) == minhash.sketch(b ^ np.uint64(s))).mean() for s in range(1, 30)])
    assert abs(agree - 800 / 1050) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (7, 7)] + [(200, x) for x in range(201, 220)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, **{i: 200 for i in range(200, 220)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- repeated strings


def brute_repeats(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mark[p] += 1
                mark[p + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("heavy,stretch", [(4 << 20, 1 << 20), (2000, 300), (0, 1000)])
def test_repeats(spark, docs, heavy, stretch, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    base = bytes(np.random.default_rng(0).integers(97, 101, 2000, dtype=np.uint8)).decode()
    rows = docs[:60] + ODD + [(900, base[:500] + base[100:400]), (901, "ab" * 300), (902, "zz" + base[50:320] + "yy"), (903, base[60:259]), (904, base[1000:1200]), (905, "q" + base[1000:1200])]
    got = repeats.remove_repeats(frame(spark, rows), heavy=heavy, with_bytes=True).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows], 200)
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert repeats.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_backward_extension_finds_all_boundaries():
    rng = np.random.default_rng(1)
    for length in (3, 8, 40):
        texts = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (5, 60, 200, length, length + 1)]
        got = repeats.repeated_starts(texts, [1] * len(texts), length)
        seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
        assert [g.tolist() for g in got] == [[p for p in range(len(t) - length + 1) if seen[t[p : p + length]] > 1] for t in texts]


def test_equal_strings_share_a_key():
    texts = [b"ab" * 300, b"x" * 500, bytes(range(256)) * 2, b"", b"short", b"ab" * 120]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s = segments(np.frombuffer(b"".join(texts), np.uint8), at)
    keys, covered = collections.defaultdict(set), collections.Counter()
    for k, t, a, n in zip(*(s[c].tolist() for c in ("key", "text", "start", "strings"))):
        for p in range(a, a + n):
            keys[texts[t][p : p + 200]].add(k)
            covered[t] += 1
    assert all(len(v) == 1 for v in keys.values())
    assert [covered[t] for t in range(len(texts))] == [max(0, len(t) - 199) for t in texts]


# ---- lines


def brute_lines(rows):
    strip = " \t\n\v\f\r"
    key = lambda x: x.strip(strip).translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            own = held[key(x)]
            top = max((d for d in own if d is not None), default=None)
            if len(key(x)) < 20 or len(own) < 3 or i == top:
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("parts,held", [(1, 10_000), (7, 1), (64, 0)])
def test_lines(spark, docs, parts, held, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", held)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that hashes lie across partitions
    try:
        check_lines(spark, docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_of_rows_that_share_an_id_as_in_sql(spark):
    import duckdb

    line = "This line is longer than twenty"
    rows = [(1, line), (1, line + "\nx"), (2, line), (3, "one other line of some length"), (4, "one other line of some length"), (4, "b"), (5, "one other line of some length")]
    kept = [(r["doc_id"], r["_lost"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()]
    duck = duckdb.connect()
    duck.execute("create table documents as select * from (values " + ",".join(f"({i}, '{t}')" for i, t in rows).replace("\n", "' || chr(10) || '") + ") t(doc_id, text)")
    want = {i: n for i, _, n, _ in duck.execute(ORACLES["op10_line_dedup"]).fetchall()}
    got = collections.Counter()
    for i, n in kept:
        got[i] += n
    assert dict(got) == want and want[1] == 0 and want[3] == 1 and want[5] == 0


def check_lines(spark, docs):
    line = "This line is longer than twenty"
    more = [(700, line + "\nx"), (701, "  " + line.upper() + "\t\n" + line), (702, "y\n" + line), (703, line + "\n" + line), (None, line), (None, "\n".join([line] * 3))]
    rows = docs[:80] + ODD + more + [(None, "only nobody holds this line"), (None, "only nobody holds this line"), (None, "only nobody holds this line\nq")]
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["_lost"], r["text"]) for r in got), key=repr) == sorted(((i, d, t) for i, _, d, t in brute_lines(rows)), key=repr)
    assert all(r["_text"] == "clash" for r in got) and line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


# ---- packing


def test_packing(spark, docs):
    plain = Tokenizer.from_file(packing.default_tokenizer())
    marked = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> a<|", "one\x1ctwo \x85three", "é e\u0301 ſtraße İ 'S don't"]
    rows = docs[:80] + ODD + [(900 + i, t) for i, t in enumerate(marked)]
    got = packing.pack_documents(frame(spark, rows), capacity=256).collect()
    direct = [np.array([*e.ids, 0], "<u4") for e in plain.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = collections.Counter()
    for (i, _), ids in zip(rows, direct):
        for k, a in enumerate(range(0, len(ids), 256)):
            want[i, k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert len(bins) <= 1.03 * -(-sum(len(x) for x in direct) // 256) + 1
    assert packing.pack_documents(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed,low,high", [(1, 1, 2048), (2, 300, 1100), (3, 700, 1000), (4, 1, 60)])
def test_plan(seed, low, high):
    rng = np.random.default_rng(seed)
    histogram = collections.Counter(rng.integers(low, high + 1, 1500).tolist())
    runs = packing.plan_packing(dict(histogram))
    ranks, bins = collections.defaultdict(list), collections.defaultdict(list)
    for length, rank, count, sequence, offset in runs.tolist():
        ranks[length] += range(rank, rank + count)
        for j in range(count):
            bins[sequence + j].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    rooms: list[int] = []  # plain best-fit decreasing
    for n in sorted(histogram.elements(), reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else 2048
        bisect.insort(rooms, room - n)
    assert len(bins) <= len(rooms)
    assert len(packing.plan_packing({})) == 0


# ---- quality


def test_quality(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    net = quality.train(docs, labels)
    rows = quality.score_documents(docs, net).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    odd = quality.score_documents(frame(spark, ODD), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score_documents(frame(spark, ODD).limit(0), net).count() == 0
    assert quality.train(docs, labels.limit(0)).out.shape == net.out.shape


def slow_score(net, text):
    """The network by its description, one window after another."""
    cells = -(-(len(text) + quality.LAGS + quality.SAME) // quality.CELL)
    flat = text + bytes(cells * quality.CELL - len(text) + quality.WIDTH)
    again = [any(p - lag - quality.SAME + 1 >= 0 and flat[p - quality.SAME + 1 : p + 1] == flat[p - lag - quality.SAME + 1 : p - lag + 1] and 0 not in flat[p - quality.SAME + 1 : p + 1] for lag in range(2, quality.LAGS + 1)) for p in range(len(flat))]
    x = np.concatenate([net.embed[list(flat)], np.array(again, np.float32)[:, None]], axis=1).astype(np.float64)
    h = [np.maximum(max_of([x[c * quality.CELL + s * quality.STEP :][: quality.WIDTH].ravel() @ net.kernel for s in range(quality.SPOTS)]) + net.bias, 0) for c in range(cells)]
    chunks = [np.maximum(a, b) for a, b in zip(h, [*h[1:], h[-1]])]
    z = np.concatenate([np.mean(chunks, axis=0), max_of(h), [1.0]]) @ net.out
    return 1 / (1 + np.exp(-z))


def max_of(rows):
    return np.max(np.stack(rows), axis=0)


def test_quality_same_as_a_slow_network():
    rng = np.random.default_rng(6)
    net = quality.fit([b"good text here " * 20, b"$$$ ### buy " * 20] * 12, [1, 0] * 12, epochs=3)
    net.embed += rng.normal(0, 0.05, net.embed.shape).astype(np.float32)
    texts = [b"", b"x", b"abcdeabcdeabcde", bytes(rng.integers(0, 256, 700, dtype=np.uint8)), b"over and " * 60, b"n" * 256, "日本 é".encode() * 40]
    at = np.cumsum([0, *map(len, texts)])
    got = quality.scores(net, np.frombuffer(b"".join(texts), np.uint8), at)
    assert np.abs(got - [slow_score(net, t) for t in texts]).max() < 1e-5


def test_quality_learns_from_long_texts(spark):
    """Labelled texts far above 16 KB, and a bound of bytes that is full after some of them."""
    rows = [(i, ("good plain words in a row " if i % 2 else "$$$ ### !!! win now ") * 1500) for i in range(40)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    for fit_bytes in (64 << 20, 400_000):
        net = quality.train(docs, labels, fit_bytes=fit_bytes)
        scored = {r["doc_id"]: r["predicted"] for r in quality.score_documents(docs, net).collect()}
        assert all(scored[i] == i % 2 for i, _ in rows)
    assert np.abs(quality.train(docs, labels, fit_bytes=0).out[:-1]).max() == 0


def test_quality_sees_the_whole_text():
    """A change anywhere changes what the filters see: every byte lies in some window."""
    net = quality.fit([b"good text " * 30, b"$$$ ### " * 30] * 20, [1, 0] * 20, epochs=4)
    text = b"good text " * 3000
    for at in (0, 15_000, len(text) - 600):
        bad = text[:at] + b"$$$ ### " * 70 + text[at + 560 :]
        both = np.frombuffer(text + bad, np.uint8)
        s = quality.scores(net, both, np.array([0, len(text), len(text) + len(bad)]))
        assert s[1] < s[0]


# ---- decontamination


def brute_leaks(docs, items):
    cut = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())

    def windows(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = {}
    for i, t in items:
        w = cut(t)
        k = min(5, len(w))
        if not k:
            continue
        own = collections.Counter(windows(w, k))
        n = sum(own.values())
        for d, (_, text) in enumerate(docs):
            s = windows(cut(text), k)
            width, best = min(n, len(s)), 0
            for p in range(len(s) - width + 1 if s else 0):
                window = collections.Counter(s[p : p + width])
                both = sum((window & own).values())
                best = max(best, both / (n + width - both))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_leaks(spark, docs, sf):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:15] + [(90, "two words"), (91, ""), (92, None), (93, "...")]
    words = items[3][1].split()
    edited = " ".join(words[:7] + ["changed"] + words[8:])
    rows = docs[:60] + [(800, "before " + items[2][1].upper() + " after"), (801, "x y " + edited + " z"), (802, " ".join(words[:6])), (803, "these Two, words!"), (804, None), (805, ""), (None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.with_leaks(frame(spark, rows).withColumn("place", F.monotonically_increasing_id()), bench).collect():
        for x in r["leaks"]:
            got[(r["doc_id"], r["text"]), x["item_id"]] = round(x["similarity"], 9)
    assert got == {(rows[d], i): s for (d, i), s in brute_leaks(rows, items).items()}
    assert ((None, items[5][1]), items[5][0]) in got
    assert decontaminate.with_leaks(frame(spark, rows), bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontaminate.with_leaks(frame(spark, rows).limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [46, 100, 200])
def test_leaks_with_repeated_shingles(n):
    rng = np.random.default_rng(n)
    make = lambda k: [f"w{x}" for x in rng.integers(0, 10**6, k)]
    items, docs = [], []
    edge = -(-8 * n // 9)  # shared shingles at a similarity of 0.8
    for i in range(8):
        words = make(n + 4)
        items.append((i, " ".join(words)))
        # about the threshold: the item's start or end, and one word over and over
        for shared in (edge - 1, edge, edge + 1):
            kept, pad = shared + 4, ["x"] * (n - shared)
            docs += [(0, " ".join(words[:kept] + pad)), (0, " ".join(make(9) + pad + words[-kept:] + make(9)))]
        # the other way round: the item repeats a word, the text doesn't
        items.append((100 + i, " ".join(words[: edge + 4] + ["x"] * (n - edge))))
    docs += [(0, " ".join(make(30) + ["x"] * 700 + make(30))), (0, items[1][1]), (0, items[0][1])]
    raw = [t.encode() for _, t in docs]
    found = decontaminate.Index(items).leaks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = {(d, i): round(s, 9) for d, x in enumerate(found) for i, s, *_ in x}
    assert got == brute_leaks(docs, items) and len(got) > 32


@pytest.mark.parametrize("n,few", [(40, 1 << 20), (40, 0), (3000, 0)])
def test_hamming_blocks_find_all_within_the_radius(n, few, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEW_PAIRS", few)
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 1 << 16, (n, decontaminate.BLOCKS)).astype(np.uint16)
    prints[5] = prints[0]
    blocks = decontaminate.Blocks(prints)
    asked = prints[:1].repeat(200, 0)
    for row in asked:
        for bit in rng.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    found = set(zip(*(x.tolist() for x in blocks.candidates(asked))))
    assert all((r, 0) in found and (r, 5) in found for r in range(len(asked)))
    assert sum(i not in (0, 5) for _, i in found) < 0.35 * len(asked) * n  # the blocks prune
    w, i, apart = blocks.within(asked)
    assert (apart <= decontaminate.RADIUS).all() and {(r, 0) for r in range(len(asked))} <= set(zip(w.tolist(), i.tolist()))


@pytest.mark.parametrize("slice_bytes", [4 << 20, 400])
def test_leaks_of_slices_and_null_items(spark, slice_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)
    text = " ".join(f"word{i}" for i in range(12))
    items = [(None, text), (-1, text), (-1, text), (3, text)] + [(10 + i, f"item {i} of the list with some more words {i * 7}") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.with_leaks(frame(spark, [(1, "a " + text), (2, "nothing")]), bench).collect()
    assert sorted(([x["item_id"] for x in r["leaks"]] for r in got), key=len) == [[], [None, -1, 3]] or {frozenset(x["item_id"] for x in r["leaks"]) for r in got} == {frozenset(), frozenset([None, -1, 3])}


# ---- sharding


def test_sharding(spark, docs):
    rows = docs + ODD
    got = sharding.shard_documents(frame(spark, rows)).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = {s: len(x) for s, x in slots.items()}
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = sharding.shard_documents(frame(spark, rows[::-1]).repartition(3)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(got, key=key) == sorted(again, key=key)
    assert sharding.shard_documents(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1025])
def test_feistel_is_a_permutation(n):
    x = sharding.feistel(np.arange(n), n, 3)
    assert sorted(x.tolist()) == list(range(n))
    if n > 60:
        assert abs(np.corrcoef(np.arange(n), x)[0, 1]) < 0.3 and (x != sharding.feistel(np.arange(n), n, 4)).any()


# ---- shared folder


def test_scratch_goes_to_the_folder_that_the_session_names(spark, tmp_path, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "hdfs://name/shared/" if key == "spark.checkpoint.dir" else default)

    assert shared_dir(Session) == "hdfs://name/shared"
    assert shared_dir(spark) == shared_dir(spark)
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    df = materialise(spark.range(5), "t")
    assert df.count() == 5 and list(tmp_path.glob("lumen-t-*"))
    discard(df)
    assert not list(tmp_path.glob("lumen-t-*"))


# ---- very long texts


def test_very_long_texts(spark):
    """Texts of over a megabyte, one of a single word, one of a single line."""
    rng = np.random.default_rng(11)
    prose = " ".join(f"w{x}" for x in rng.integers(0, 10**7, 160_000))
    item = " ".join(f"item{i}" for i in range(40))
    line = "a line that several documents hold"
    rows = [(1, prose), (2, prose[:-300] + " " + item), (3, "x" * 1_200_000), (4, "x" * 1_200_001), (5, "\n".join([line, *(f"line {i} of the long document {i * i}" for i in range(40_000))])), (6, line), (7, line + "\nend")]
    df = frame(spark, rows)
    near = {r["doc_id"]: r for r in minhash.near_duplicates(df, k=2).collect()}
    assert {i: r["component_id"] for i, r in near.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    assert all(near[i]["n_shingles"] == len(shingle_set(t, 2)) for i, t in rows)
    gone = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(df).collect()}
    assert gone[1] == (len(prose), len(prose) - 300, 1) and gone[2][1:] == (len(prose) - 300, 1)
    assert gone[3] == (1_200_000, 1_200_000, 1) and gone[4] == (1_200_001, 1_200_001, 1) and gone[6] == (len(line), 0, 0)
    kept = {r["doc_id"]: (r["_lost"], r["text"]) for r in line_dedup.dedup_lines(df).collect()}
    assert kept[5] == (1, rows[4][1][len(line) + 1 :]) and kept[6] == (1, "") and kept[7] == (0, line + "\nend") and kept[3][1] == rows[2][1]
    leaks = {r["doc_id"]: [(x["item_id"], x["similarity"]) for x in r["leaks"]] for r in decontaminate.with_leaks(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert leaks == {1: [], 2: [(9, 1.0)], 3: [], 4: [], 5: [], 6: [], 7: []}
    packed = packing.pack_documents(df.where("doc_id in (1, 5)")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    assert all(r["pieces"] == -(-r["n"] // 2048) for r in packed)


def test_many_equal_rows(spark, monkeypatch):
    """20,000 rows of one id and text, and as many of null id: one text each is moved, compared and cut."""
    monkeypatch.setattr(minhash, "release", lambda *frames: None)
    monkeypatch.setattr(repeats, "discard", lambda frame: None)
    kept = {}
    for module in (minhash, repeats):
        plain = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name="step", plain=plain: kept.setdefault(name, plain(df, name)))
    text = " ".join(f"w{i % 97}x{i}" for i in range(120))
    other = text.replace("w5x5 ", "w5y5 ")
    hot = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = hot.unionByName(spark.createDataFrame([(9, other), (3, "nothing like it at all"), (None, other + " more")], "doc_id long, text string"))
    got = {(r["doc_id"], r["component_id"], r["kept"]): r["n"] for r in minhash.near_duplicates(docs, k=2).groupBy("doc_id", "component_id", "kept").agg(F.count("*").alias("n")).collect()}
    assert got == {(7, 7, True): 20_000, (None, 7, False): 20_001, (9, 7, False): 1, (3, 3, True): 1}
    assert kept["texts"].count() == kept["texts"].select("_node").distinct().count() == 3
    out = repeats.remove_repeats(docs)
    assert {(r["doc_id"], r["n_removed"], r["n"]) for r in out.groupBy("doc_id", "n_removed").agg(F.count("*").alias("n")).collect()} >= {(7, len(text), 20_000), (None, len(text), 20_001), (3, 0, 1)}
    assert kept["pieces"].count() == kept["pieces"].dropDuplicates(["_k", "_d1", "_d2", "_s"]).count() < 100
    assert kept["segments"].count() < 200


def test_null_ids_are_linked(spark):
    rng = np.random.default_rng(8)
    base = [f"t{rng.integers(10**6)}" for _ in range(200)]
    near = lambda i: " ".join([*base[:i], f"edit{i}", *base[i + 1 :]])
    lone = [f"u{rng.integers(10**6)}" for _ in range(100)]
    rows = [(5, near(3)), (None, near(9)), (None, near(30)), (None, " ".join(lone)), (None, " ".join(lone[:50] + ["x"] + lone[50:])), (None, " ".join(lone)), (8, "far away"), (8, near(77))]
    got = collections.defaultdict(list)
    for r in minhash.near_duplicates(frame(spark, rows), k=2).collect():
        got[r["doc_id"], r["n_shingles"]].append((r["component_id"], r["kept"]))
    assert got[5, 199] == [(5, True)] and got[None, 199] == [(5, False)] * 2 and got[8, 1] == got[8, 199] == [(5, False)]
    # no id in the component: one text is kept, with its equals
    alone = got[None, 99] + got[None, 100]
    assert {c for c, _ in alone} == {None} and sorted(k for _, k in alone) in ([False, True, True], [False, False, True])


@pytest.mark.parametrize("a_pass", [1, 2])
def test_leaks_of_a_benchmark_of_many_passes(spark, a_pass, monkeypatch):
    """Beyond one pass leaks meet the rows by their texts; rows, repeated ones and columns with clashing names stay as they are."""
    items = [(i, f"question {i} asks what the {i * 37} of {i * 11} things in the box of number {i} may be called") for i in range(24)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "So " + items[3][1] + " and " + items[17][1].upper(), "a"), (1, "So " + items[3][1] + " and " + items[17][1].upper(), "b"), (2, None, "c"), (3, "", "d"), (None, items[5][1], "e"), (4, "clean " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _a string")
    see = lambda df: sorted(repr((r["doc_id"], r["text"], r["_a"], sorted(tuple(x) for x in r["leaks"]))) for r in df.collect())
    whole = see(decontaminate.with_leaks(docs, bench))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 300)
    monkeypatch.setattr(decontaminate, "SLICES_A_PASS", a_pass)
    many = decontaminate.with_leaks(docs, bench)
    assert many.columns == [*docs.columns, "leaks"] and see(many) == whole
    assert sum("[(3, " in x and "(17, " in x for x in whole) == 2 and sum("[(5, " in x for x in whole) == 1
