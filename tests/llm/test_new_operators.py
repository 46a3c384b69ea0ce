"""Spelling variants, whitening and SimHash against brute force, and their odd rows."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenledger.llm import simhash, spelling, whitening
from lumenledger.llm.oracle import ORACLES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---- spelling variants


def brute_variants(rows):
    c = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    n = {w: k for w, k in c.items() if len(w) >= 6 and k >= 5}
    near = {w: {o for o in n if o != w and spelling.one_edit(w, o)} for w in n}
    form = {w: min(near[w], key=lambda o: (-n[o], o)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def got_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary_rows(seed):
    """Words of few letters and their misspellings, in counts from 1 to 400; a third of all words share beginning and length."""
    rng = np.random.default_rng(seed)
    letters = list("abcdé")
    words = ["".join(rng.choice(letters, rng.integers(5, 10))) for _ in range(150)]
    words += ["hotword" + "".join(rng.choice(letters, 2)) for _ in range(80)]
    for w in list(words[:60]):
        i = int(rng.integers(0, len(w)))
        words += [w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :]]
    counts = rng.choice([1, 4, 5, 6, 30, 31, 150, 400], len(words))
    tokens = [w if rng.random() < 0.8 else w.upper() for w, k in zip(words, counts) for _ in range(int(k))]
    # variants of variants; the rule of deletions takes some of the first words
    tokens += ["lantern"] * 900 + ["lanterm"] * 160 + ["lantemm"] * 30 + ["lamtemm"] * 6
    rng.shuffle(tokens)
    marks = [" ", "-", "9", "\n", "ß"[:0] + "—", "_", "٣"]
    docs = np.array_split(np.array(tokens, dtype=object), 60)
    return [(i, "".join(t + marks[int(rng.integers(0, len(marks)))] for t in d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("crowd", [1024, 4, 0])
def test_variants(spark, crowd, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 50)
    monkeypatch.setattr(spelling, "STRETCH", 37)
    rows = vocabulary_rows(crowd)
    want = brute_variants(rows)
    assert got_variants(spelling.variants(frame(spark, rows), crowd=crowd)) == want
    assert sum(f is not None for f, *_ in want.values()) > 20 and any(r != f for f, r, *_ in want.values() if f)


def test_variants_of_odd_rows(spark):
    rows = [(None, "lantern " * 30), (1, None), (2, ""), (3, "lanters " * 6 + "lanteres " * 5), (3, "lanters"), (3, "lanters"), (4, "x" * 200_000 + " short words here " + "Lantern"), (5, "é" * 7 + " " + ("é" * 7 + " ") * 9), (6, "É" * 7 + " "), (7, "naïveté " * 12 + "naiveté " * 7 + "naïvete " * 5)]
    docs = spark.createDataFrame([(*r, "n", "w") for r in rows], "doc_id long, text string, word string, _word string")
    got = got_variants(spelling.variants(docs))
    assert got == brute_variants(rows) and got["lanters"][0] == ("lantern" if got["lantern"][2] >= 5 * got["lanters"][2] else None)
    assert spelling.variants(docs.limit(0)).count() == 0 and spelling.variants(frame(spark, [(1, "abc de")])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=6, max_size=9), st.integers(0, 8), st.sampled_from("abéz"), st.sampled_from(["insert", "delete", "replace"]))
def test_near_words_meet_under_their_first_shared_trigram(word, i, letter, kind):
    """Any edit, whatever the order of trigrams: the pair meets in one key, passes the count, and is verified."""
    i = min(i, len(word) - 1)
    other = {"insert": word[:i] + letter + word[i:], "delete": word[:i] + word[i + 1 :], "replace": word[:i] + letter + word[i + 1 :]}[kind]
    if other == word or len(other) < 6:
        return
    import pyarrow as pa

    words = [word, other]
    assert spelling.one_edit(word, other)
    for seed in range(3):
        ranks = np.random.default_rng(seed).permutation(spelling.ALPHABET**3).astype(np.int32)
        rows = [r for b in spelling._post(ranks)(iter([pa.record_batch([pa.array(words)], names=["word"])])) for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (r[0], r[1]))
        # members enough that the count filter works, none of them near
        keys = {r[0] for r in rows}
        fill = [(k, False, "q" * ((k & 0xFFFFF) - 1) + c, [], []) for k in keys for c in "rstuv"]
        batch = [pa.array(c) for c in zip(*((r[0], -1, r[1], r[2], r[3]) for r in sorted(fill + rows, key=lambda r: (r[0], r[1]))))]
        found = [p for b in spelling._merge(iter([pa.record_batch(batch, names=list("kpaws"))])) for p in zip(*(c.to_pylist() for c in b.columns))]
        found = [p for p in found if set(p) == {word, other}]
        assert found, (word, other, seed)


def test_variants_same_as_duckdb(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    found = c.sql(ORACLES["op11_spelling"])
    at = {n: i for i, n in enumerate(found.columns)}
    want = {r[at["word"]]: tuple(r[at[n]] for n in ("form", "root", "n", "n_near", "form_n")) for r in found.fetchall()}
    assert got_variants(spelling.variants(spark.read.parquet(f"{sf}/documents.parquet"))) == want and len(want) > 500


# ---- whitening


def whitened(df):
    rows = df.toPandas()
    return rows, rows.pivot_table(index="vec_id", columns="component", values="whitened")


def check_whitening(spark, vectors, k, exact=1e-8):
    """Against dense eigenvectors of the exact covariance."""
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows, got = whitened(whitening.whiten(df, k))
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    m = got.shape[1]
    want = centred @ vec[:, :m] / np.sqrt(e[:m])
    sign = np.sign((got.values * want).sum(0))
    assert np.abs(got.values * sign - want).max() < exact
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"].iloc[0] < 1e-9 and set(rows["n"]) == {n}
    deviations = rows.groupby("vec_id")["deviation"].first()
    assert [int(d) for d in deviations] == [sum(int(v) ** 2 for v in n * r - s) for r in x]
    shares = rows.groupby("component")["explained"].first().values
    assert np.abs(shares / (e[:m] / e.sum()) - 1).max() < 1e-9
    return m


def test_whitening(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 12)) * np.linspace(3, 0.5, 12) + 100 * rng.normal(size=12)
    assert check_whitening(spark, vectors, 32) == 12 and check_whitening(spark, vectors, 3) == 3


def test_whitening_iterates(spark):
    """Many more dimensions than columns of the block: passes go on until the residuals certify."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(200, 60)) * np.geomspace(40, 0.5, 60)
    assert check_whitening(spark, vectors, 4) == 4
    x = np.floor(64 * vectors)
    v = np.cov(x.T, bias=True)
    values, vecs, passes = whitening.eigenpairs(lambda q: v @ q, 60, 4)
    assert passes > 3 and np.abs(v @ vecs - vecs * values).max() < 1e-10 * values[0] and np.allclose(vecs.T @ vecs, np.eye(4), atol=1e-12)


def test_whitening_leaves_out_what_has_no_variance(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-5, 6, (50, 2))
    vectors = np.hstack([base, base.sum(1, keepdims=True), np.full((50, 1), 7)]) / 64  # rank two
    assert check_whitening(spark, vectors, 4) == 2
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(1)).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(same.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (None, [3.0, -1.0]), (3, [-0.26, 0.25])]
    bad = [(4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, []), (9, [1e300, 0.0])]
    longer = [(20, [1.0, 2.0, 4.0]), (21, [0.0, 1.0, 0.0]), (22, [5.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in good + bad + longer], "vec_id long, embedding array<float>, n int, component string")
    rows = whitening.whiten(df).collect()
    assert collections.Counter(r["vec_id"] for r in rows) == {1: 2, 2: 4, None: 2, 3: 2, 20: 2, 21: 2, 22: 2}
    assert {r["n"] for r in rows if r["vec_id"] == 20} == {3} and {r["n"] for r in rows if r["vec_id"] == 1} == {5}
    x = np.array([[64, 0], [0, 128], [0, 128], [192, -64], [-17, 16]])
    want = {tuple(sorted(str(int(v)) for v in ((5 * x - x.sum(0)) ** 2).sum(1)))}
    assert {tuple(sorted(str(r["deviation"]) for r in rows if r["component"] == 1 and r["n"] == 5))} == want
    wide = spark.createDataFrame([(i, [float(v), float(w)]) for i, (v, w) in enumerate([(2**50, 0), (-(2**49), 1), (3, 2**50)])], "vec_id long, embedding array<double>")
    y = [[int(64 * v) for v in r] for r in ([2**50, 0], [-(2**49), 1], [3, 2**50])]
    sums = [sum(c) for c in zip(*y)]
    exact = [sum((3 * v - s) ** 2 for v, s in zip(r, sums)) for r in y]
    assert sorted(int(r["deviation"]) for r in whitening.whiten(wide).where("component = 1").collect()) == sorted(exact)


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for j in range(64):
            ones[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * ones[j] > len(grams))


def brute_classes(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprints(monkeypatch, spark):
    texts = ["", " \t\n", "one", "One two", "one two three", "a b c a b c a b c", "É é É é x", "w " * 500, "tab\tand\x0bvertical\x0cfeed\rreturn", "non breaking space stays", " ".join(f"w{i % 37}" for i in range(300))]
    for stretch in (1 << 20, 7):
        monkeypatch.setattr(simhash, "STRETCH", stretch)
        for t in texts:
            assert simhash.fingerprint(t.encode()) == brute_fingerprint(t), t
    native = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0] % 2**64
    assert native == brute_fingerprint("one two three")


def clouds(seed, n=400):
    """Fingerprints around a few centres: chains of small steps, and a third of all around one."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    for i in range(n):
        at = out[0] if i % 3 == 0 else out[int(rng.integers(0, len(out)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 6))):
            at ^= 1 << int(b)
        out.append(at)
    return sorted(set(out))


@pytest.mark.parametrize("crowd", [2048, 3, 0])
def test_links_are_complete(spark, crowd, monkeypatch):
    prints = clouds(crowd)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "_fp long")
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, crowd).collect()]
    assert all(bin(a ^ b).count("1") <= 3 * 64 for a, b in edges)
    place = {x: i for i, x in enumerate(prints)}
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        i, j = root(place[a]), root(place[b])
        up[max(i, j)] = min(i, j)
    assert [root(i) for i in range(len(prints))] == brute_classes(prints)
    # no more than a few edges a fingerprint, though a third of them are near each other
    assert len(edges) < 30 * len(prints)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), min_size=1, max_size=3))
def test_chains_bring_near_fingerprints_together(value, flips):
    """The pigeonring principle, for whole keys and for the parts of crowded ones."""
    other = value
    for b in flips:
        other ^= 1 << b
    pair = np.array([value, other], np.uint64)

    def keys(words, width):
        own, guest = [set(), set()], [set(), set()]
        for found, rows in simhash._chains(words, width):
            for k, i in zip(found.tolist(), range(len(words)) if rows is None else rows.tolist()):
                (own if rows is None else guest)[i].add(k)
        return own, guest

    own, guest = keys(pair, 16)
    meet = (own[0] & (own[1] | guest[1])) | (own[1] & guest[0])
    assert meet
    good = False
    for k in meet:
        start = k >> 32
        turned = np.array([(x >> 16 * ((start + 2) % 4) | x << 64 - 16 * ((start + 2) % 4)) & 0xFFFFFFFF for x in (value, other)], np.uint64)
        own2, guest2 = keys(turned, 8)
        three = sum(0xFFFF << 16 * ((start + j) % 4) for j in range(3))
        split = (own2[0] & (own2[1] | guest2[1])) | (own2[1] & guest2[0])
        good |= bool(split) and bin((value ^ other) & three).count("1") <= 2
    assert good


def test_near_documents(spark):
    base = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    rows = [(9, base), (4, base + " and"), (7, base.upper()), (None, base), (1, None), (2, ""), (3, "  "), (5, "quite another text of its own"), (5, "quite another text of its own"), (None, "only here without id"), (6, "x" * 300_000 + " y z")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, component_id string, _fp int")
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    classes = brute_classes(prints)
    ids = {c: [d for (d, _), k in zip(rows, classes) if k == c and d is not None] for c in classes}
    want = collections.Counter((d, f"{p:016x}", min(ids[c]) if ids[c] else None) for (d, _), p, c in zip(rows, prints, classes))
    assert got == want and got[1, "0" * 16, 1] == 1 and got[3, "0" * 16, 1] == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_documents_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, crowd=1).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    classes = brute_classes(prints)
    assert got == {d: (f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, classes)}
