"""Vector search by pivots and rings, and the limits of banded hash search."""

import numpy as np
import pytest

from lumenledger.operators import hashmatch, rangesearch

SCHEMA = "id long, vector array<double>"


def brute(q, v, below):
    out = {}
    for i, a in q:
        for j, b in v:
            d = float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))
            if d < below:
                out[i, j] = round(d, 9)
    return out


def found(df):
    rows = df.collect()
    out = {(r["q_id"], r["id"]): round(r["distance"], 9) for r in rows}
    assert len(out) == len(rows)
    return out


def test_line_of_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], SCHEMA)
    got = found(rangesearch.vector_search(df.where("id % 10 = 0"), df, 1.5))
    assert got == {(q, q + d): float(abs(d)) for q in (0, 10, 20, 30) for d in (-1, 0, 1) if q + d >= 0}
    assert rangesearch.vector_search(df.limit(0), df, 1.0).count() == 0 and rangesearch.vector_search(df, df.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        rangesearch.vector_search(df, df, 0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    """Clusters, one of which holds a third of all rows; parts of 50 vectors, so hot rings are cut."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 8)) * 4
    which = np.where(rng.random(900) < 0.34, 0, rng.integers(0, 30, 900))
    rows = [(i, (centres[c] + rng.normal(size=8) * 0.3).tolist()) for i, c in enumerate(which)]
    queries = rows[::15]
    q, v = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(rows, SCHEMA)
    df = rangesearch.vector_search(q, v, 1.0, pivots=24, part=50)
    assert found(df) == brute(queries, rows, 1.0)
    cost = rangesearch.search_cost(q, v, 1.0, pivots=24).first()
    assert cost["pairs"] == len(queries) * 900 and 0 < cost["compared"] < 0.35 * cost["pairs"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [0.1, 0.0]), (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert set(found(rangesearch.vector_search(df, df, 0.5))) == {(a, b) for a in (1, 6, 7) for b in (1, 6, 7)}


def test_banded_search_has_a_bound(spark):
    hashes = spark.createDataFrame([(1, 0, 0), (2, 0, 255)], "id long, hi long, lo long")
    assert [tuple(r) for r in hashmatch.near_pairs(hashes, hashmatch.MOST).collect()] == [(1, 2, 8)]
    for search in (lambda: hashmatch.near_pairs(hashes, hashmatch.MOST + 1), lambda: hashmatch.search(hashes, hashes, -1)):
        with pytest.raises(ValueError, match="most"):
            search()
