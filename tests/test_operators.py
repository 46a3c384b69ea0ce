"""Edges of the ledger operators on hand-made rows."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenledger.functions import image_metrics as im
from lumenledger.functions.names import allowed_set, base, extension
from lumenledger.functions.rounding import half_up
from lumenledger.functions.values import as_uuid, elapsed_ms, has_prefix, new_id
from lumenledger.operators import commits, hashmatch, ingest, lookup, mutate, paging, relations, summary
from lumenledger.sources import files, ledger
from lumenledger.sources.schema import IMAGE_DEFAULTS, IMAGES, conform
from lumenledger.streaming import jobs

COLUMNS = "id long, user_id long, status string, ssim_score double, psnr_score double, processing_time_ms int, original_size_bytes int, protected_size_bytes int, created_at long"


def ledger_rows(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture
def golden(spark):
    return ledger_rows(
        spark,
        [
            (1, 1, "completed", 0.90, 30.0, 100, 0, None, 5),
            (2, 1, "completed", 0.95, 32.0, 200, 0, None, 5),
            (3, 1, "failed", None, None, 50, 0, None, 5),
            (4, 1, "pending", None, None, None, 0, None, 6),
        ],
    )


def test_golden_summary(golden):
    row = summary.summary_of(golden, 1).first()
    assert (row["total_images"], row["completed"], row["failed"], row["pending"]) == (4, 2, 1, 1)
    assert (row["avg_ssim"], row["avg_psnr"], row["total_processing_time_ms"], row["total_original_bytes"]) == (0.925, 31.0, 300, 0)


def test_summary_of_nobody_and_of_zero_averages(spark, golden):
    row = summary.summary_of(golden, 99).first()
    assert (row["total_images"], row["avg_ssim"], row["total_protected_bytes"]) == (0, None, 0)
    zero = ledger_rows(spark, [(1, 1, "completed", 0.0, 0.0, 1, 1, 1, 1), (2, 1, "quality_warning", 0.9, 9.0, 1, 1, 1, 1)])
    row = summary.summary_of(zero, 1).first()
    assert row["avg_ssim"] is None and row["total_images"] == 2 and row["completed"] + row["failed"] + row["pending"] == 1
    assert summary.response({"avg_ssim": 0.92504, "avg_psnr": 2.675}) == {"avg_ssim": 0.925, "avg_psnr": 2.67}


def test_pages(golden):
    ids = lambda p, n: [r["id"] for r in paging.page_of(golden, 1, p, n).collect()]
    assert ids(1, 2) == [4, 3] and ids(2, 2) == [2, 1] and ids(3, 2) == [] and ids(0, 2) == [4, 3] and ids(1, 0) == []
    with pytest.raises(ValueError):
        paging.page_of(golden, 1, 1, -1)


def test_at_most_one(golden):
    assert lookup.at_most_one(lookup.by_key(golden, "id", 77)) is None
    assert lookup.at_most_one(lookup.by_key(golden, "id", 3))["status"] == "failed"
    with pytest.raises(ValueError):
        lookup.at_most_one(golden)


def test_names(spark):
    rows = [("a.PNG", "png", "a"), ("a.tar.gz", "gz", "a.tar"), ("none", "unknown", "none"), (".hidden", "hidden", ".hidden"), ("..a.b", "b", "..a"), ("a.", "", "a"), (None, "unknown", None), ("", "unknown", "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "n string").select(extension(F.col("n")), base(F.col("n")))
    assert [tuple(r) for r in df.collect()] == [r[1:] for r in rows]
    assert allowed_set(" jpg, PNG ,,webp ") == {"jpg", "png", "webp"}


def most_rows_read(spark, df, **conf):
    """Of all tasks that run for the rows: the most rows that one of them reads from a shuffle."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"} | conf
    before, sc, group = {k: spark.conf.get(k) for k in conf}, spark.sparkContext, f"rows-{id(df)}"
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        df.write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {k for job in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(job).stageIds}
    lists = [store.taskList(k, 0, 1000) for k in stages]
    return max(x.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for x in lists for i in range(x.size()))


def test_downloads_of_images_without_a_path_are_many_tasks(spark):
    image = F.col("id")
    path = F.when(image % 4 == 0, F.concat(F.lit("store/"), image.cast("string"))).alias("protected_path")
    status = F.when(image % 4 == 1, "pending").otherwise("completed").alias("status")
    images = spark.range(4000).select("id", (image % 50).alias("user_id"), status, path, F.concat(F.lit("a"), image.cast("string"), F.lit(".jpg")).alias("original_filename"), (image % 8 == 0).alias("vault_sealed"))
    listing = images.where("protected_path is not null and id % 3 != 0").select(F.col("protected_path").alias("path"))
    listing = listing.unionAll(listing).unionAll(spark.createDataFrame([(None,), ("store/x",)], "path string"))
    asked = images.select(image.alias("image_id"), (F.col("user_id") + F.when(image % 5 == 0, 1).otherwise(0)).alias("user_id")).unionAll(spark.createDataFrame([(9999, 1), (None, 1)], "image_id long, user_id long"))
    got = {r["image_id"]: tuple(r)[2:] for r in lookup.resolved(asked, images, listing).collect()}
    nothing = (None, None)
    for i in range(4000):
        kind = "unknown" if i % 5 == 0 else "not ready" if i % 4 == 1 else "missing" if i % 4 or i % 3 == 0 else "found"
        shown = (f"protected_a{i}.enc", "application/octet-stream") if i % 8 == 0 else (f"protected_a{i}.png", "image/png")
        assert got[i] == (kind, *(shown if kind == "found" else nothing))
    assert got[9999] == got[None] == ("unknown", *nothing) and len(got) == 4002
    assert most_rows_read(spark, lookup.resolved(asked, images, listing)) < 2000


def test_mutations(spark, golden):
    changes = spark.createDataFrame([(1, "failed", None), (9, "failed", 1.0)], "id long, status string, ssim_score double")
    rows = {r["id"]: (r["status"], r["ssim_score"]) for r in mutate.overlay(golden, changes, "id", "status", "ssim_score").collect()}
    assert rows[1] == ("failed", None) and rows[2] == ("completed", 0.95) and len(rows) == 4
    salts = spark.range(3).select(mutate.random_salt().alias("s")).collect()
    assert all(len(r["s"]) == 64 and int(r["s"], 16) >= 0 for r in salts)
    failed = mutate.mark_failed(golden.withColumn("error_message", F.lit(None).cast("string")), F.col("id") == 1, F.lit("x" * 600)).where("id = 1").first()
    assert failed["status"] == "failed" and len(failed["error_message"]) == 500 and failed["processing_time_ms"] == 100


def test_cascade_and_integrity(spark, golden):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, email string")
    left, kept = mutate.terminate(users, golden, users.where("id = 1"))
    assert left.count() == 1 and kept.count() == 0
    assert relations.orphans(golden, users.where("id = 2")).count() == 4
    assert [r["n"] for r in relations.nested(users, golden, "id").select(F.size("images").alias("n")).orderBy("id").collect()] == [4, 0]
    assert relations.duplicate_keys(golden.unionAll(golden), "id").count() == 4
    empty = golden.limit(0)
    assert relations.nested(users, empty, "id").count() == 2 and summary.by_status(empty).count() == 0


def test_evolution_round_trip(spark, tmp_path):
    old = spark.createDataFrame([("i", "u", "f.png")], "id string, user_id string, original_filename string")
    path = str(tmp_path / "images")
    ledger.append_images(old, path)
    row = ledger.read_images(spark, path).first()
    assert row["eot_iterations"] == 50 and row["watermark_enabled"] is True and row["status"] == "pending" and row["ssim_score"] is None
    with pytest.raises(ValueError):
        conform(old.drop("user_id"), IMAGES, IMAGE_DEFAULTS)


def png(path, rgb):
    h, w, _ = rgb.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    rgb = np.random.default_rng(42).integers(50, 200, (32, 24, 3), dtype=np.uint8)
    png(tmp_path / "a.png", rgb)
    png(tmp_path / "b.png", np.clip(rgb.astype(int) + 3, 0, 255).astype(np.uint8))
    (tmp_path / "c.png").write_bytes(b"not an image")
    (tmp_path / "d.txt").write_bytes(b"x")
    riff = lambda body: b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    (tmp_path / "e.webp").write_bytes(riff(b"VP8L" + struct.pack("<IB", 5, 0x2F) + struct.pack("<I", 23 | 31 << 14)))
    (tmp_path / "f.WebP").write_bytes(riff(b"VP8X" + struct.pack("<I", 10) + b"\0" * 4 + struct.pack("<I", 639)[:3] + struct.pack("<I", 479)[:3]))
    (tmp_path / "g.webp").write_bytes(riff(b"VP8 " + struct.pack("<I", 10) + b"\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", 320, 200)))
    (tmp_path / "h.webp").write_bytes(b"RIFF\xff\0\0\0WEBPVP8X cut short")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.decoded(spark, str(tmp_path)).collect()}
    assert rows["c.png"]["height"] < 0 and (rows["a.png"]["width"], rows["a.png"]["height"]) == (24, 32)
    shown = im.pixels(bytes(rows["a.png"]["pixels"]), 32, 24, 3)
    assert (shown[:, :, ::-1] == rgb).all() and np.allclose(im.to_unit(shown), rgb.transpose(2, 0, 1) / 255)
    s, p = im.quality(*[(bytes(rows[k]["pixels"]), rows[k]["height"], rows[k]["width"], 3) for k in ("a.png", "b.png")])
    assert 0.9 < s < 1 and abs(p - 10 * np.log10(65025 / 9)) < 0.2
    refused = {r["path"].rsplit("/", 1)[1]: r["refused"] for r in files.judged_uploads(spark, str(tmp_path)).collect()}
    assert refused == {"a.png": None, "b.png": None, "c.png": "unreadable", "d.txt": "extension", "e.webp": None, "f.WebP": None, "g.webp": None, "h.webp": "unreadable"}
    webp = spark.read.format("binaryFile").load(str(tmp_path / "*[bB][pP]")).select("path", files.webp_size(F.col("content")).alias("s")).collect()
    assert {r["path"][-6]: tuple(r["s"]) for r in webp if r["s"]} == {"e": (24, 32), "f": (640, 480), "g": (320, 200)}
    assert files.dimensions(spark, str(tmp_path)).count() == 2
    both = files.decoded(spark, str(tmp_path)).where("height > 0").select(F.struct("pixels", "height", "width", "channels").alias("x"))
    assert all(r["q"]["ssim"] == 1.0 and r["q"]["psnr"] == float("inf") for r in both.select(im.quality_udf("x", "x").alias("q")).collect())


def test_metrics():
    a = np.full((16, 16), 100, np.uint8)
    assert im.ssim(a, a) == 1.0 and im.psnr(a, a) == float("inf") and im.quality((b"", -1, -1, 3), (b"", 2, 2, 3)) == (0.0, 0.0)
    b = np.full((16, 16), 110, np.uint8)
    c1 = (0.01 * 255) ** 2
    assert abs(im.ssim(a, b) - (2 * 100 * 110 + c1) / (100**2 + 110**2 + c1)) < 1e-12
    assert im.gray(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[29, 150, 76]]
    x = np.arange(16, dtype=np.float64).reshape(4, 4)
    assert np.allclose(im.resize(x, 2, 2), [[2.5, 4.5], [10.5, 12.5]]) and np.allclose(im.resize(x, 4, 4), x)
    colour = np.random.default_rng(0).integers(0, 255, (16, 16, 3), dtype=np.uint8)
    assert im.ssim_colour(colour, colour) == 1.0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=5), st.integers(0, 8))
def test_bands_find_every_near_hash(value, flips, most):
    """Pigeonhole: hashes within ``most`` bits agree in two of most + 2 bands."""
    other = value
    for f in flips:
        other ^= 1 << f
    edges = [64 * i // (most + 2) for i in range(most + 3)]
    same = sum((value >> (64 - b)) % (1 << (b - a)) == (other >> (64 - b)) % (1 << (b - a)) for a, b in zip(edges, edges[1:]))
    assert same >= 2 or len(flips) > most


def test_protect_chain(spark, tmp_path):
    """Upload rules, insert, queue, overlay and publish as one flow."""
    uploads = spark.createDataFrame([("a", "7", "one.jpg", 10), ("b", "7", "two.exe", 10), ("c", "8", "three.png", 20), ("d", "8", "four.png", 0)], "id string, user_id string, name string, length long")
    taken, refused = ingest.split(uploads)
    assert {r["id"]: r["refused"] for r in refused.collect()} == {"b": "extension", "d": "empty"}
    store = str(tmp_path / "images")
    ledger.append_images(ingest.as_images(taken), store)
    images = ledger.read_images(spark, store)
    assert {r["id"]: (r["status"], r["original_path"]) for r in images.collect()} == {"a": ("pending", "in/a"), "c": ("pending", "in/c")}
    schema = "id string, ssim_score double, psnr_score double, started timestamp, ended timestamp, error string"
    queued = images.selectExpr("id", "0.97D as ssim_score", "31D as psnr_score", "timestamp'2024-01-01 00:00:00' as started", "timestamp'2024-01-01 00:00:00.0299' as ended", "if(id = 'c', 'no face', null) as error")
    queued.write.parquet(str(tmp_path / "queue"))
    jobs.run_queue(spark, str(tmp_path / "queue"), queued.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    done = spark.read.schema(spark.read.parquet(str(tmp_path / "out")).schema).parquet(str(tmp_path / "out")).drop("batch")
    after = mutate.persist_results(mutate.mark_processing(images, F.col("status") == "pending"), done)
    commits.publish(after, str(tmp_path / "table"))
    rows = {r["id"]: (r["status"], r["processing_time_ms"], r["error_message"], r["watermark_enabled"]) for r in commits.read(spark, str(tmp_path / "table")).collect()}
    assert rows == {"a": ("completed", 29, None, True), "c": ("failed", 29, "no face", True)} and schema


def test_salts_are_sealed_once(spark):
    df = spark.createDataFrame([(1, False, 5, "p"), (2, True, 6, "v")], "id long, vault_sealed boolean, protected_size_bytes int, protected_path string")
    rows = mutate.seal(df, F.lit(True), F.lit(9), F.lit("vault/x")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, True, 9, "vault/x"), (2, True, 6, "v")]


def test_hamming_join_is_complete(spark):
    rng = np.random.default_rng(3)
    base_ = rng.integers(0, 2**32, (60, 2))
    rows = []
    for i, (hi, lo) in enumerate(base_.tolist()):
        rows.append((3 * i, hi, lo))
        rows.append((3 * i + 1, hi ^ (1 << int(rng.integers(32))), lo ^ (1 << int(rng.integers(32)))))
        rows.append((3 * i + 2, hi, lo))
    df = spark.createDataFrame(rows, "id long, hi long, lo long")
    got = {(r[0], r[1]): r[2] for r in hashmatch.near_pairs(df, 3).collect()}
    first = {}
    for i, hi, lo in rows:
        first.setdefault((hi, lo), i)
    keys = sorted((i, h) for h, i in first.items())
    want = {}
    for x, (i, a) in enumerate(keys):
        for j, b in keys[x + 1 :]:
            d = (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count()
            if d <= 3:
                want[i, j] = d
    assert got == want and hashmatch.near_pairs(df.limit(0), 3).count() == 0


def test_hash_dedupe(spark):
    rows = [(1, "full", "abc"), (2, "full", "abc"), (3, "center_92", "def"), (4, "", "ignored"), (5, "center_84", None)]
    out = hashmatch.dedupe(spark.createDataFrame(rows, "id long, hash_kind string, phash string")).collect()
    assert sorted((r["hash_kind"], r["phash"], r["id"]) for r in out) == [("center_92", "def", 3), ("full", "abc", 1)]
    shapes = spark.createDataFrame([("0" * 16,), ("0" * 15,), ("G" * 16,), (None,)], "h string").select(hashmatch.well_formed(F.col("h")))
    assert [r[0] for r in shapes.collect()] == [True, False, False, False]


def test_values(spark):
    rows = [("{12345678-1234-5678-1234-567812345678}",), ("12345678123456781234567812345678",), ("nope",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(as_uuid(F.col("t"))).collect()]
    assert got == ["12345678-1234-5678-1234-567812345678"] * 2 + [None] * 3
    ids = [r[0] for r in spark.range(50).select(as_uuid(new_id())).collect()]
    assert len(set(ids)) == 50 and all(i[14] == "4" for i in ids)
    big = [0.0, 1.25, -1.25, float("inf"), float("-inf"), 1e300, None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in big], "x double").select(half_up(F.col("x"), 1)).collect()] == [0.0, 1.3, -1.2, float("inf"), float("-inf"), 1e300, None]
    texts = spark.createDataFrame([("store/1",), ("in/1",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(has_prefix(F.col("t"), "store/", "vault/")).collect()] == [True, False, False, False]
    assert spark.range(1).select(elapsed_ms(F.lit(1.0), F.lit(2.9996))).first()[0] == 1999


def test_ingest(spark):
    df = spark.createDataFrame([("a.jpg", 10), ("b.exe", 10), ("c.png", None), ("d.png", 99), (None, 1)], "name string, length long")
    taken, refused = ingest.split(df, max_bytes=50)
    assert [r["name"] for r in taken.collect()] == ["a.jpg"]
    assert {r["name"]: r["refused"] for r in refused.collect()} == {"b.exe": "extension", "c.png": "empty", "d.png": "size", None: "extension"}


def test_job_stream(spark, tmp_path):
    schema = "id long, ssim_score double, psnr_score double, started timestamp, ended timestamp, error string"
    data = spark.sql("select id, 0.94 + id / 100D as ssim_score, 30D as psnr_score, timestamp'2024-01-01 00:00:00' as started, timestamp'2024-01-01 00:00:01.5' as ended, case when id = 2 then repeat('x', 600) end as error from range(3)")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    data.write.parquet(source)
    for _ in range(2):
        jobs.run_queue(spark, source, data.schema, sink, str(tmp_path / "ck")).awaitTermination()
    rows = {r["id"]: r for r in spark.read.parquet(sink).collect()}
    assert [rows[i]["status"] for i in range(3)] == ["quality_warning", "completed", "failed"]
    assert rows[0]["processing_time_ms"] == 1500 and len(rows[2]["error_message"]) == 500 and schema
