"""Versions, conflicts and rollback; files laid out for lookups and joins; Bloom filters and their generations."""

import threading

import pytest
from pyspark.sql import functions as F

from lumenledger.operators import commits, membership, mutate
from lumenledger.sources import layout


def names(root):
    return sorted(p.name for p in (root / "data").iterdir()) if (root / "data").exists() else []


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(LookupError):
        commits.read(spark, root)
    df = spark.range(5)
    assert commits.latest(spark, root) == 0 and commits.read(spark, root, schema=df.schema).count() == 0
    assert commits.publish(df, root) == 1 and commits.publish(df.where("id > 2"), root, action="delete") == 2
    assert commits.read(spark, root).count() == 2 and commits.read(spark, root, 1).count() == 5
    assert [(r["version"], r["based_on"], r["action"]) for r in commits.history(spark, root).collect()] == [(1, 0, "write"), (2, 1, "delete")]


def test_a_late_writer_is_refused_and_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    commits.publish(spark.range(3), root)
    first, second = commits.Write(spark, root), commits.Write(spark, root)
    first.stage(spark.range(10))
    second.stage(spark.range(20))
    assert first.commit() == 2
    with pytest.raises(commits.Conflict):
        second.commit()
    assert commits.read(spark, root).count() == 10 and second.name not in names(tmp_path) and len(names(tmp_path)) == 2
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_writers_at_once(spark, tmp_path):
    """Of many that start from one version exactly one comes in; with retries all do, one on top of the other."""
    root = str(tmp_path)
    commits.publish(spark.range(1), root)
    won, lost, gate = [], [], threading.Barrier(4)

    def race(i):
        write = commits.Write(spark, root, 1).stage(spark.range(10 + i))
        gate.wait()
        try:
            won.append((write.commit(), i))
        except commits.Conflict:
            lost.append(i)

    def run(target):
        threads = [threading.Thread(target=target, args=(i,)) for i in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()

    run(race)
    assert len(won) == 1 and len(lost) == 3 and commits.read(spark, root).count() == 10 + won[0][1] and len(names(tmp_path)) == 2
    run(lambda i: commits.transact(spark, root, lambda last: last.unionByName(spark.range(1000 + i, 1001 + i)), tries=20))
    assert commits.latest(spark, root) == 6
    assert {r["id"] for r in commits.read(spark, root).where("id >= 1000").collect()} == {1000, 1001, 1002, 1003}


def test_an_address_is_registered_once(spark, tmp_path):
    """Requests for one address at the same time: the second sees what the first committed."""
    root = str(tmp_path)
    commits.publish(spark.createDataFrame([(1, "a@x", "first")], "id long, email string, display_name string"), root)

    def ask(i):
        new = spark.createDataFrame([(10 + i, "new@x", f"asker {i}"), (20 + i, f"own{i}@x", "")], "id long, email string, display_name string")
        commits.transact(spark, root, lambda users: mutate.register(users, new), tries=20, action="register")

    threads = [threading.Thread(target=ask, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    emails = sorted(r["email"] for r in commits.read(spark, root).collect())
    assert emails == ["a@x", "new@x", "own0@x", "own1@x", "own2@x"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    commits.publish(spark.range(3), root)
    with pytest.raises(Exception, match="broken"):
        commits.publish(spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), root)
    assert commits.read(spark, root).count() == 3 and len(names(tmp_path)) == 1


def test_dead_writers_block_nothing(spark, tmp_path):
    root = str(tmp_path)
    commits.publish(spark.range(3), root)
    dead = commits.Write(spark, root).stage(spark.range(7))  # never committed
    assert commits.publish(spark.range(4), root) == 2
    assert commits.vacuum(spark, root, 3600) == [] and commits.vacuum(spark, root, -1) == [dead.name]
    assert commits.read(spark, root).count() == 4 and commits.read(spark, root, 1).count() == 3


def scanned(df):
    """Rows that scans put out in a run of ``df``."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return total


def test_lookups_skip_row_groups(spark, tmp_path):
    """Hashed ids lie everywhere, so minima and maxima prune nothing; Bloom filters do."""
    rows = spark.range(0, 200_000, numPartitions=1).select(F.md5(F.col("id").cast("string")).alias("id"), (F.col("id") % 50).alias("user_id"), F.sha2(F.col("id").cast("string"), 512).alias("pad"))
    plain, indexed = str(tmp_path / "plain"), str(tmp_path / "indexed")
    rows.write.option("parquet.block.size", str(1 << 20)).parquet(plain)
    layout.write_indexed(rows, indexed, {"id": 10_000}, group_bytes=1 << 20)
    wanted = F.col("id") == F.md5(F.lit("77777"))
    read = {p: spark.read.parquet(p).where(wanted).select("id", "user_id") for p in (plain, indexed)}
    assert all(df.count() == 1 for df in read.values())
    without, with_filter = (scanned(read[p]) for p in (plain, indexed))
    assert without == 200_000 and with_filter < 40_000


def test_clustering_prunes_files(spark, tmp_path):
    rows = spark.range(20_000).select("id", (F.col("id") % 97).alias("user_id"))
    path = str(tmp_path / "t")
    layout.write_indexed(rows, path, {}, cluster_by=("user_id",), files=6)
    ranges = [r for r in spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("user_id").alias("a"), F.max("user_id").alias("b")).orderBy("a").collect()]
    assert len(ranges) > 1 and all(x["b"] < y["a"] for x, y in zip(ranges, ranges[1:]))
    assert scanned(spark.read.parquet(path).where("user_id = 3")) < 20_000 / (len(ranges) - 1)


def test_buckets_join_without_an_exchange(spark):
    users = spark.range(300).withColumnRenamed("id", "user_id")
    images = spark.range(3000).select("id", (F.col("id") % 300).alias("user_id"))
    name = f"t{abs(hash(test_buckets_join_without_an_exchange)) % 10**6}"
    try:
        layout.write_bucketed(users, f"{name}_users", "user_id", 4)
        layout.write_bucketed(images, f"{name}_images", "user_id", 4)
        joined = spark.table(f"{name}_images").hint("merge").join(spark.table(f"{name}_users"), "user_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 3000
    finally:
        for t in ("users", "images"):
            spark.sql(f"drop table if exists {name}_{t}")


def test_bloom(spark):
    held = spark.createDataFrame([("0123456789abcdef",), ("f" * 16,), ("f" * 16,), (None,)], "h string")
    sizing = membership.Sizing.of(3)
    assert sizing == membership.Sizing(1, 10)
    bits = membership.build(held, "h", sizing)
    assert [r["might_contain"] for r in membership.probe(held, "h", bits, sizing).orderBy("h").collect()] == [None, True, True, True]
    assert membership.probe(held.limit(0), "h", bits, sizing).count() == 0
    nothing = membership.build(held.limit(0), "h", sizing)
    assert nothing.count() == 0 and membership.known(held, held.limit(0), "h").count() == 0
    assert [r["might_contain"] for r in membership.probe(held.limit(1), "h", nothing, sizing).collect()] in ([False], [])


def test_bloom_in_parts(spark):
    """Many parts, a value that half of all probes hold, and a measured error rate; no part is broadcast."""
    sizing = membership.Sizing.of(300_000)
    bits = membership.build(spark.range(300_000), "id", sizing)
    assert sizing.parts == 5 and bits.count() == 5 and all(len(r["bits"]) == membership.PART_BITS // 8 for r in bits.collect())
    told = membership.probe(spark.range(300_000), "id", bits, sizing)
    assert told.where("might_contain").count() == 300_000
    others = membership.probe(spark.range(10**7, 10**7 + 200_000), "id", bits, sizing).where("might_contain").count()
    assert others < 2 * 0.001 * 200_000
    fill = membership.fill(bits, sizing).first()
    assert fill["parts"] == 5 and 0.4 < fill["fullest"] < 0.55 and fill["error_rate"] < 0.002
    hot = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("v"), F.col("id").alias("part"))
    got = membership.probe(hot, "v", bits, sizing, each=1000)
    assert got.where("might_contain").count() == 20_000 and got.columns == ["v", "part", "might_contain"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_bloom_generations(spark, tmp_path):
    root, sizing = str(tmp_path), membership.Sizing.of(100_000)
    assert membership.rebuild(spark, root, spark.range(1000), "id", sizing) == 1
    assert membership.rebuild(spark, root, spark.range(5000, 6000), "id", sizing) == 2
    held = spark.range(1000).unionByName(spark.range(5000, 6000))
    now = commits.read(spark, root)
    assert membership.probe(held, "id", now, sizing).where("might_contain").count() == 2000
    assert membership.probe(held, "id", commits.read(spark, root, 1), sizing).where("might_contain").count() < 1010
    assert {bytes(r["bits"]) for r in now.collect()} == {bytes(r["bits"]) for r in membership.build(held, "id", sizing).collect()}
