"""Hashes, resampling, blurs and the PNG sink on decoded images."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenledger.functions import augment, perceptual
from lumenledger.functions import image_metrics as im
from lumenledger.operators import hashmatch
from lumenledger.plans.queries import REGISTRY
from lumenledger.sources import files, filesink

IMAGE = "name string, pixels binary, height int, width int, channels int"


def scene(h=96, w=128, seed=1):
    """A smooth picture: a few broad waves."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w] / max(h, w)
    waves = sum(rng.normal() * np.cos(2 * np.pi * (rng.uniform(0, 3) * x + rng.uniform(0, 3) * y) + rng.uniform(0, 6)) for _ in range(8))
    return np.clip(128 + 30 * waves, 0, 255).astype(np.uint8)


def bits_apart(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def plain_phash(plane):
    """By the definition: mean over cells, cosine sums, median."""
    h, w = plane.shape
    cells = perceptual.area_weights(h, 32) @ plane.astype(float) @ perceptual.area_weights(w, 32).T
    at = np.arange(32)
    wave = lambda u: np.cos(np.pi * (2 * at + 1) * u / 64)
    found = [(wave(u)[:, None] * wave(v) * cells).sum() for u in range(8) for v in range(8)]
    return "".join("01"[int(c > np.median(found))] for c in found)


def test_phash_is_the_definition():
    for seed in range(5):
        p = scene(seed=seed)
        assert bits_apart(perceptual.phash(p), f"{int(plain_phash(p), 2):016x}") == 0
    assert np.allclose(perceptual.area_weights(5, 3).sum(1), 1) and np.allclose(perceptual.area_weights(100, 32).sum(1), 1)


def test_phash_holds_under_edits():
    p = scene()
    h = perceptual.phash(p)
    assert bits_apart(h, perceptual.phash((p * 0.7).astype(np.uint8))) <= 4
    assert bits_apart(h, perceptual.phash(np.clip(p.astype(int) + 20, 0, 255).astype(np.uint8))) <= 6
    assert bits_apart(h, perceptual.phash(im.to_bytes(im.lanczos(p, 48, 64)))) <= 4
    assert bits_apart(h, perceptual.phash(im.to_bytes(im.lanczos(p, 190, 300)))) <= 4
    assert bits_apart(h, perceptual.phash(im.to_bytes(im.blurred(p, 1.5)))) <= 4
    assert all(bits_apart(h, perceptual.phash(scene(seed=s))) > 12 for s in range(2, 12))
    assert bits_apart(h, perceptual.phash(p[:, ::-1])) > 12


def test_image_hashes_of_files(spark, tmp_path):
    """PNG files through Spark's image source: a library, and suspects that are brighter, smaller and cut."""
    p = scene()
    shown = [("a", p), ("b", scene(seed=2)), ("c", scene(seed=3))]
    cut = p[perceptual.window(*p.shape, perceptual.CROPS["middle"])]
    asked = [("bright", np.clip(p.astype(int) + 15, 0, 255).astype(np.uint8)), ("small", im.to_bytes(im.lanczos(p, 40, 60))), ("cut", cut), ("other", scene(seed=9))]
    for kind, rows in (("library", shown), ("suspects", asked)):
        (tmp_path / kind).mkdir()
        for name, plane in rows:
            (tmp_path / kind / f"{name}.png").write_bytes(filesink.encode(plane[:, :, None]))
    (tmp_path / "library" / "broken.png").write_bytes(b"no image")
    hashes = {k: perceptual.image_hashes(files.decoded(spark, str(tmp_path / k))) for k in ("library", "suspects")}
    stored = hashes["library"].collect()
    assert {r["path"].rsplit("/", 1)[1] for r in stored} == {"a.png", "b.png", "c.png"}
    assert [r["hash_kind"] for r in stored if r["path"].endswith("a.png")][0] == "full" and all((r["place"] == 0) == (r["hash_kind"] == "full") for r in stored)
    coded = lambda df: df.select(F.regexp_extract("path", "([a-z]+).png", 1).alias("id"), *[h.alias(n) for h, n in zip(hashmatch.halves(F.col("phash")), ("hi", "lo"))])
    whole = hashmatch.search(coded(hashes["suspects"].where("place = 0")), coded(hashes["library"].where("place = 0")), 6)
    region = hashmatch.search(coded(hashes["suspects"]), coded(hashes["library"]), 6)
    got = {r["q_id"]: (r["id"], r["method"]) for r in hashmatch.cascade(("whole", whole), ("region", region)).collect()}
    assert got == {"bright": ("a", "whole"), "small": ("a", "whole"), "cut": ("a", "region")}


def test_candidates_come_once():
    flat = np.full((16, 16), 7, np.uint8)
    assert [k for k, _ in perceptual.hashes_of(flat, perceptual.CROPS)] == ["full"]
    assert len(perceptual.hashes_of(scene(), perceptual.CROPS)) == 6
    assert perceptual.phash(np.zeros((1, 1), np.uint8)) == "0" * 16


def test_plane_images_leave_out_what_is_none(spark):
    rows = [(1, [0.1] * 64), (2, [0.1] * 63), (3, None), (4, [None] * 64), (5, [float("nan")] * 64)]
    got = perceptual.plane_images(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["id"], len(r["pixels"]), r["pixels"][0]) for r in got] == [(1, 64, 153)]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40))
def test_lanczos_weights(n, m):
    w = im.lanczos_weights(n, m)
    assert w.shape == (m, n) and np.allclose(w.sum(1), 1)
    assert np.allclose(w, w[::-1, ::-1])
    if n == m:
        assert np.allclose(w, np.eye(n))


def test_lanczos_and_blur():
    p = scene().astype(float)
    back = im.lanczos(im.lanczos(p, 192, 256), 96, 128)
    assert np.abs(back - p)[4:-4, 4:-4].max() < 1.5
    flat = np.full((9, 11, 3), 77.0)
    assert np.allclose(im.lanczos(flat, 4, 30), 77) and np.allclose(im.blurred(flat, 1.2), 77)
    dot = np.zeros((15, 15))
    dot[7, 7] = 1
    spread = im.blurred(dot, 1.0)
    assert abs(spread.sum() - 1) < 1e-12 and np.allclose(spread, spread.T) and spread.argmax() == 7 * 15 + 7
    assert abs(spread[7, 8] / spread[7, 7] - np.exp(-0.5)) < 1e-12
    a, b = scene(), scene(48, 64)
    row = lambda x: (x.tobytes(), *x.shape, 1)
    fine, rough = im.quality(row(a), row(im.to_bytes(im.lanczos(a, 48, 64))), "lanczos"), im.quality(row(a), row(im.to_bytes(im.lanczos(a, 48, 64))), "bilinear")
    assert fine[0] > 0.99 and fine[1] > rough[1] and im.quality(row(b), row(b), "lanczos", colour=True) == (1.0, float("inf"))


def test_crops_are_the_same_in_every_run(spark):
    rows = [(f"i{i}", scene(20 + i, 30, i).tobytes(), 20 + i, 30, 1) for i in range(12)]
    df = spark.createDataFrame(rows, IMAGE.replace("name", "id"))
    one, other = (augment.augmented(df.repartition(n), 3).collect() for n in (1, 5))
    key = lambda rs: {(r["id"], r["iteration"]): bytes(r["pixels"]) for r in rs}
    assert key(one) == key(other) and len(key(one)) == 36 and len(set(key(one).values())) == 36
    boxes = augment.crop_boxes(df, 40).join(df.select("id", "height", "width"), "id").collect()
    assert all(b["top"] >= 0 and b["left"] >= 0 and b["top"] + b["box_height"] <= b["height"] and b["left"] + b["box_width"] <= b["width"] for b in boxes)
    assert all(b["box_height"] >= int(0.8 * b["height"]) and 0.1 <= b["sigma"] < 1 for b in boxes) and len({b["top"] for b in boxes}) > 3
    one_pixel = spark.createDataFrame([("x", b"\x05", 1, 1, 1), ("bad", b"", -1, -1, 1)], IMAGE.replace("name", "id"))
    assert [bytes(r["pixels"]) for r in augment.augmented(one_pixel, 2).collect()] == [b"\x05"] * 2


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3, 4]), st.integers(0, 2**32 - 1))
def test_png_bytes(h, w, c, seed):
    """Read back by the format's own rules: chunks, checksums, filters."""
    import struct
    import zlib

    image = np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)
    data, at, body = filesink.encode(image), 8, b""
    while at < len(data):
        n, tag = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(tag + part)
        body += part if tag == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c).astype(int)
    out = np.zeros((h, w * c), int)
    for y in range(h):
        for x in range(w * c):
            left = out[y, x - c] if x >= c else 0
            up = out[y - 1, x] if y else 0
            corner = out[y - 1, x - c] if y and x >= c else 0
            guess = left + up - corner
            paeth = min(((abs(guess - v), i, v) for i, v in enumerate((left, up, corner))))[2]
            out[y, x] = (raw[y, 1 + x] + (0, left, up, (left + up) // 2, paeth)[raw[y, 0]]) % 256
    back = out.reshape(h, w, c).astype(np.uint8)
    back = back if c == 1 else np.concatenate([back[:, :, 2::-1], back[:, :, 3:]], axis=2)
    assert (back == image).all()


def test_image_files_are_dealt_out_and_listed_once(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "scratch", lambda *_: str(tmp_path / "images"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a small table's files are as many tasks as a large one's
    try:
        (tmp_path / "images").mkdir()
        found = REGISTRY["image_files"](spark, sf)
        assert found.rdd.getNumPartitions() <= 64
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    held = [len(list(p.iterdir())) for p in (tmp_path / "images").glob("write=*/part=*")]
    assert sum(held) == 500 and len(held) > 32 and max(held) < 50
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = found.collect()
    assert {r["id"] for r in rows} == set(range(500)) and all(r["held"] and (r["width"], r["height"], r["channels"]) == (8, 8, 1) for r in rows)


def test_length_of_decoded_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(filesink.encode(np.full((2, 3 + i, 1), i, np.uint8)) if i else b"no image")
    assert {r["path"].rsplit("/", 1)[1]: r["length"] for r in files.decoded(spark, str(tmp_path)).collect()} == {p.name: p.stat().st_size for p in tmp_path.iterdir()}


def test_png_sink(spark, tmp_path):
    filesink.register(spark)
    rng = np.random.default_rng(5)
    pictures = {f"p{i}.jpeg": rng.integers(0, 256, (3 + i, 5, (1, 3)[i % 2]), dtype=np.uint8) for i in range(8)}
    df = spark.createDataFrame([(n, x.tobytes(), *x.shape) for n, x in pictures.items()], IMAGE)
    root = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    df.repartition(4).write.format(filesink.PNG).mode("append").save(root)
    read = lambda: spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*").collect()
    got = {r["origin"].rsplit("/", 1)[1]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"]) for r in read()}
    assert set(got) == {f"p{i}.png" for i in range(8)}
    assert all((got[n.replace("jpeg", "png")] == x).all() for n, x in pictures.items())
    # one bad image among good ones: nothing of the write is left
    bad = df.unionByName(spark.createDataFrame([("bad", b"", 0, 0, 3)], IMAGE))
    with pytest.raises(Exception, match="no image"):
        bad.repartition(4).write.format(filesink.PNG).mode("append").save(root)
    assert len(read()) == 8 and len(list((tmp_path / "out").iterdir())) == 1
    df.limit(0).write.format(filesink.PNG).mode("append").save(root)
    df.limit(2).write.format(filesink.PNG).mode("append").save(root)
    assert len(read()) == 10
    with pytest.raises(ValueError):
        filesink.png_name("../x")
    assert [filesink.png_name(n) for n in ("a.jpg", "a", "a.b.png")] == ["a.png", "a.png", "a.b.png"]


def test_blob_sink(spark, tmp_path):
    filesink.register(spark)
    rows = [("a_vault.enc", bytes(range(256))), ("b_vault.enc", b""), ("c_vault.enc", None)]
    root = str(tmp_path / "vault")
    (tmp_path / "vault").mkdir()
    spark.createDataFrame(rows, "name string, content binary").write.format(filesink.BLOB).mode("append").save(root)
    got = {p.name: p.read_bytes() for p in (tmp_path / "vault").rglob("*_vault.enc")}
    assert got == {n: b or b"" for n, b in rows}
    with pytest.raises(Exception, match="not a file name"):
        spark.createDataFrame([("../out", b"x")], "name string, content binary").write.format(filesink.BLOB).mode("append").save(root)
    with pytest.raises(Exception, match="missing"):
        spark.createDataFrame([("x",)], "name string").write.format(filesink.BLOB).mode("append").save(root)
    assert len(list((tmp_path / "vault").iterdir())) == 1


def test_compare():
    a = scene()
    row = lambda x: (x.tobytes(), *x.shape, 1)
    assert im.compare(row(a), row(a)) == (1.0, 0.0) and im.compare(row(a), (b"", -1, -1, 1)) == (0.0, 1.0)
    s, shift = im.compare(row(a), row(np.clip(a.astype(int) + 8, 0, 255).astype(np.uint8)))
    assert 0.9 < s < 1 and abs(shift - 8 / 255) < 1e-12
    assert im.compare(row(a), row(im.to_bytes(im.lanczos(a, 48, 64))))[0] > 0.98
