"""One named query for each operator, over the test tables shown as ledger tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.functions import image_metrics as im
from lumenledger.functions import perceptual, vectors
from lumenledger.functions.augment import crop_boxes
from lumenledger.functions.image_metrics import psnr_of, ssim
from lumenledger.functions.names import base, extension
from lumenledger.functions.rounding import half_up
from lumenledger.functions.values import as_uuid, expiry, has_prefix
from lumenledger.operators import hashmatch, ingest, lookup, membership, mutate, paging, rangesearch, relations, summary
from lumenledger.sources import files, filesink, ledger
from lumenledger.sources.schema import IMAGE_DEFAULTS, IMAGES, add_column, conform
from lumenledger.streaming.jobs import finished, outcome
from lumenledger.streaming.queue import schedule

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

USER = 7


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _six(c):
    return half_up(c, 6)


# ---- summaries and counts


@query
def summary_one_user(spark, sf_dir):
    return summary.summary_of(ledger.images(spark, sf_dir), USER)


@query
def summary_all_users(spark, sf_dir):
    return summary.summary_of_all(ledger.users(spark, sf_dir), ledger.images(spark, sf_dir))


@query
def summary_idle_users(spark, sf_dir):
    """Summaries over failed images only, so that many users have none."""
    failed = ledger.images(spark, sf_dir).where("status = 'failed'")
    return summary.summary_of_all(ledger.users(spark, sf_dir), failed)


@query
def status_breakdown(spark, sf_dir):
    return summary.by_status(ledger.images(spark, sf_dir))


@query
def image_count(spark, sf_dir):
    return paging.total_of(ledger.images(spark, sf_dir), USER)


# ---- pages

_PAGE = lookup.LISTED
_SHORT = ("id", "user_id", "created_at", "status")


@query
def list_page(spark, sf_dir):
    return paging.page_of(ledger.images(spark, sf_dir), USER, 1, 5).select(*_PAGE)


@query
def list_page_past_end(spark, sf_dir):
    return paging.page_of(ledger.images(spark, sf_dir), USER, 10_000, 20).select(*_PAGE)


@query
def list_page_ties(spark, sf_dir):
    """Many equal timestamps: pages over all images cut to the month."""
    rows = ledger.images(spark, sf_dir).withColumn("user_id", F.lit(USER)).withColumn("created_at", F.date_trunc("month", "created_at"))
    return paging.page_of(rows, USER, 3, 20).select("id", "status")


@query
def list_page_all_users(spark, sf_dir):
    return paging.page_of_all(ledger.images(spark, sf_dir), 2, 3).select(*_SHORT, "position")


@query
def list_response(spark, sf_dir):
    """Total, page and images of one answer; the page is shown as it was asked for."""
    rows = paging.response(ledger.images(spark, sf_dir), USER, 0, 4, *lookup.LISTED)
    ids = F.array_join(F.transform("images", lambda x: F.concat_ws(":", x["id"].cast("string"), x["status"])), ",")
    return rows.select("total", "page", "page_size", ids.alias("images"))


# ---- lookups and projections


def _owner(images: DataFrame, image_id: int):
    """The owner of an image, as a scalar subquery of the plan."""
    return lookup.by_key(images, "id", image_id).select("user_id").scalar()


@query
def status_lookup(spark, sf_dir):
    images = ledger.images(spark, sf_dir)
    return lookup.status_of(images, 1, _owner(images, 1))


@query
def image_by_owner(spark, sf_dir):
    """An image asked for by its owner and by another user: only the first sees it."""
    images = ledger.images(spark, sf_dir)
    owner = _owner(images, 2)
    return lookup.owned(images, 2, owner).unionByName(lookup.owned(images, 2, owner + 1)).select("id", "user_id", "status")


@query
def user_by_key(spark, sf_dir):
    return lookup.by_key(ledger.users(spark, sf_dir), "email", "customer#000000007@example.com").select(*lookup.PROFILE)


@query
def active_users(spark, sf_dir):
    return lookup.active(ledger.users(spark, sf_dir)).select("id", "display_name")


@query
def download_name(spark, sf_dir):
    return lookup.files_of(ledger.images(spark, sf_dir))


@query
def download_resolve(spark, sf_dir):
    """Every image asked for by its owner, or each fifth by another user; every seventh file is gone."""
    images = ledger.images(spark, sf_dir)
    requests = images.select(F.col("id").alias("image_id"), (F.col("user_id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("user_id"))
    files = images.where("protected_path is not null and id % 7 != 0").select(F.col("protected_path").alias("path"))
    return lookup.resolved(requests, images, files)


@query
def existing_files(spark, sf_dir):
    """Images whose file is in a listing."""
    images = ledger.images(spark, sf_dir).select("id", F.concat(F.lit("store/"), F.col("id").cast("string")).alias("path"))
    listing = _table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.concat(F.lit("store/"), F.col("l_orderkey").cast("string")).alias("path"))
    return lookup.existing(images, "path", listing).select("id")


@query
def json_response(spark, sf_dir):
    salt = F.nullif(F.col("vault_salt"), F.lit("")).alias("salt")
    return lookup.as_json(ledger.users(spark, sf_dir).select("id", "email", salt, "is_active"))


# ---- relations and integrity


@query
def eager_load_semi(spark, sf_dir):
    few = ledger.users(spark, sf_dir).where("segment = 'BUILDING'")
    return relations.images_of(ledger.images(spark, sf_dir), few).select("id", "user_id", "status")


@query
def image_with_owner(spark, sf_dir):
    return relations.with_owner(ledger.images(spark, sf_dir), ledger.users(spark, sf_dir), "display_name", "is_active").select("id", "user_id", "owner_display_name", "owner_is_active")


@query
def images_nested(spark, sf_dir):
    failed = ledger.images(spark, sf_dir).where("status = 'failed'")
    rows = relations.nested(ledger.users(spark, sf_dir), failed, "id")
    return rows.select("id", F.size("images").cast("long").alias("n_images"), F.array_join(F.transform("images", lambda x: x["id"].cast("string")), ",").alias("image_ids"))


@query
def orphan_images(spark, sf_dir):
    few = ledger.users(spark, sf_dir).where("is_active")
    return relations.orphans(ledger.images(spark, sf_dir), few).select("id", "user_id")


@query
def duplicate_keys(spark, sf_dir):
    return relations.duplicate_keys(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


# ---- mutations


@query
def register_user(spark, sf_dir):
    """Three requests, two with a new address and of these the smaller id comes in; one address is held."""
    users = ledger.users(spark, sf_dir).select("id", "email", "display_name")
    new = spark.createDataFrame([(-2, "new@example.com", "second"), (-3, "new@example.com", "first"), (-1, "customer#000000001@example.com", "held")], "id long, email string, display_name string")
    return mutate.register(users, new).select("id", "email", "display_name")


@query
def mark_processing(spark, sf_dir):
    images = ledger.images(spark, sf_dir)
    return mutate.mark_processing(images, (F.col("status") == "pending") & (F.col("id") % 4 == 0)).select("id", "status")


@query
def mark_failed(spark, sf_dir):
    images = ledger.images(spark, sf_dir)
    message = F.repeat(F.concat(F.lit("error "), F.col("id").cast("string"), F.lit(";")), 80)
    rows = mutate.mark_failed(images, (F.col("status") == "processing") & (F.col("id") % 2 == 1), message)
    return rows.select("id", "status", "error_message", "processing_time_ms")


@query
def persist_result(spark, sf_dir):
    images = ledger.images(spark, sf_dir)
    done = images.where("status = 'processing'").select(
        "id", outcome((F.lit(90) + F.col("id") % 10) / F.lit(100.0), F.when(F.col("id") % 7 == 0, "x")).alias("status"),
        ((F.lit(90) + F.col("id") % 10) / F.lit(100.0)).alias("ssim_score"), F.lit(30.5).alias("psnr_score"),
        F.floor(F.col("original_size_bytes") / 3).cast("int").alias("protected_size_bytes"), F.lit(0.03125).alias("epsilon_used"),
        F.lit(None).cast("string").alias("original_path"), F.concat(F.lit("store/"), F.col("id").cast("string")).alias("protected_path"),
    )
    return mutate.persist_results(images, done).select(
        "id", "status", _six(F.col("ssim_score")).alias("ssim_score"), _six(F.col("psnr_score")).alias("psnr_score"), "protected_size_bytes",
        _six(F.col("epsilon_used")).alias("epsilon_used"), "original_path", "protected_path",
    )


@query
def seal_vault(spark, sf_dir):
    """Images of users with even ids are sealed for the first time; sealed ones aren't again."""
    images = ledger.images(spark, sf_dir)
    path = F.concat(F.lit("vault/"), F.col("id").cast("string"))
    return mutate.seal(images, F.col("user_id") % 2 == 0, (F.col("original_size_bytes") + 16).cast("int"), path).select("id", "status", "vault_sealed", "protected_size_bytes", "protected_path")


@query
def backfill_salt(spark, sf_dir):
    fixed = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    return mutate.backfill_salt(ledger.users(spark, sf_dir), fixed).select("id", "vault_salt")


@query
def delete_one(spark, sf_dir):
    """Two images, one asked for by its owner and one by another user: only the first goes."""
    images = ledger.images(spark, sf_dir)
    asked = images.where("id in (3, 4)").select(F.col("id").alias("image_id"), (F.col("user_id") + F.col("id") - 3).alias("user_id"))
    return mutate.delete_owned(images, asked).select("id")


@query
def purge_user(spark, sf_dir):
    return mutate.purge(ledger.images(spark, sf_dir), USER).select("id", "user_id")


@query
def terminate_user(spark, sf_dir):
    users, images = ledger.users(spark, sf_dir), ledger.images(spark, sf_dir)
    left, kept = mutate.terminate(users, images, users.where("not is_active and segment = 'MACHINERY'"))
    counts = kept.groupBy("user_id").agg(F.count("*").alias("n"))
    return left.join(counts, F.col("id") == F.col("user_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n_images"))


@query
def add_column_default(spark, sf_dir):
    old = ledger.images(spark, sf_dir).select("id", "vault_sealed")
    old = old.withColumn("watermark_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("w"), F.col("id").cast("string"))))
    return add_column(add_column(old, "watermark_enabled", "boolean", True), "watermark_id", "string", "")


@query
def token_expiry(spark, sf_dir):
    return ledger.images(spark, sf_dir).select("id", expiry(F.col("created_at"), 90).alias("expires_at"))


@query
def uuid_guard(spark, sf_dir):
    """Identifiers in several spellings, some broken."""
    h = F.md5(F.col("id").cast("string"))
    dashed = F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    text = F.when(F.col("id") % 4 == 0, dashed).when(F.col("id") % 4 == 1, F.upper(h)).when(F.col("id") % 4 == 2, F.substring(h, 1, 31)).otherwise(F.concat(F.lit("{"), dashed, F.lit("}")))
    return ledger.users(spark, sf_dir).select("id", as_uuid(text).alias("uuid"))


# ---- ingest


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.images(spark, sf_dir).select("id", F.col("original_filename").alias("name"), F.col("original_size_bytes").alias("length"))


@query
def upload_validity(spark, sf_dir):
    return ingest.judged(_uploads(spark, sf_dir), max_bytes=200_000).select("id", "extension", "refused")


@query
def upload_quarantine(spark, sf_dir):
    taken, refused = ingest.split(_uploads(spark, sf_dir), max_bytes=200_000)
    count = refused.groupBy("refused").agg(F.count("*").alias("n"))
    return taken.agg(F.count("*").alias("n")).select(F.lit("taken").alias("refused"), "n").unionByName(count)


@query
def upload_message(spark, sf_dir):
    rows = ingest.judged(_uploads(spark, sf_dir)).where("refused = 'extension'")
    return rows.select("id", ingest.message().alias("message"))


@query
def protect_chain(spark, sf_dir):
    """Uploads that are taken, as waiting images, through the work of a batch: status after each of the two steps."""
    uploads = _uploads(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "name", "length").withColumn("user_id", F.lit(str(USER)))
    taken, _ = ingest.split(uploads, max_bytes=200_000)
    waiting = conform(ingest.as_images(taken), IMAGES, IMAGE_DEFAULTS)
    score = F.lit(0.9) + (F.col("id").cast("long") % 10) / F.lit(100.0)
    jobs = waiting.select("id", score.alias("ssim_score"), F.lit(30.0).alias("psnr_score"), F.timestamp_millis(F.lit(0)).alias("started"), F.timestamp_millis(F.col("id").cast("long") % 5000).alias("ended"), F.when(F.col("id").cast("long") % 11 == 0, "no face").alias("error"))
    after = mutate.persist_results(mutate.mark_processing(waiting, F.col("status") == "pending"), finished(jobs))
    return after.select(F.col("id").cast("long").alias("id"), "status", "processing_time_ms", "error_message", "protection_strength", "watermark_enabled")


@query
def prefix_test(spark, sf_dir):
    return ledger.images(spark, sf_dir).select("id", has_prefix(F.col("protected_path"), "store/1", "store/3").alias("stored"))


@query
def upload_count_cap(spark, sf_dir):
    rows = ledger.images(spark, sf_dir).withColumn("request", F.concat_ws("/", F.col("user_id").cast("string"), F.year("created_at").cast("string")))
    return ingest.oversized_batches(rows, "request", 4)


@query
def extension_of(spark, sf_dir):
    names = ledger.images(spark, sf_dir)
    return names.select("id", extension(F.col("original_filename")).alias("extension"), base(F.col("original_filename")).alias("base"))


# ---- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _against(spark: SparkSession, sf_dir: str, vec_id: int) -> DataFrame:
    """All vectors beside one query vector (one row, broadcast)."""
    rows = _vectors(spark, sf_dir)
    one = rows.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query")).limit(1)
    return rows.join(F.broadcast(one))


def _digest(v):
    """Two sums over all components, the second weighted by place."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    placed = F.aggregate(F.transform(v, lambda x, i: x * (i + 1).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return _six(total).alias("total"), half_up(placed, 4).alias("placed")


@query
def cosine_to_query(spark, sf_dir):
    return _against(spark, sf_dir, 3).select("vec_id", _six(vectors.cosine(F.col("embedding"), F.col("query"))).alias("cosine"))


@query
def cosine_topk(spark, sf_dir):
    rows = _against(spark, sf_dir, 3).select("vec_id", _six(vectors.cosine(F.col("embedding"), F.col("query"))).alias("cosine"))
    return rows.orderBy(F.desc("cosine"), "vec_id").limit(10)


@query
def cosine_batch_mean(spark, sf_dir):
    rows = _against(spark, sf_dir, 3).select("label", vectors.cosine(F.col("embedding"), F.col("query")).alias("c"))
    return rows.groupBy("label").agg(_six(F.avg("c")).alias("mean_cosine"), F.count("*").alias("n"))


@query
def nearest_under_threshold(spark, sf_dir):
    rows = _against(spark, sf_dir, 3).where("vec_id != 3").select("vec_id", _six(vectors.euclidean(F.col("embedding"), F.col("query"))).alias("distance"))
    return rows.where("distance < 1.2e0").orderBy("distance", "vec_id").limit(1)


@query
def dynamic_weights(spark, sf_dir):
    """Weights of three losses of every vector: its cosine distances from three others."""
    rows = _vectors(spark, sf_dir)
    anchors = rows.where("vec_id in (3, 4, 5)").agg(*[F.max(F.when(F.col("vec_id") == i, F.col("embedding"))).alias(f"a{i}") for i in (3, 4, 5)])
    d = [F.lit(1.0) - vectors.cosine(F.col("embedding"), F.col(f"a{i}")) for i in (3, 4, 5)]
    return rows.join(F.broadcast(anchors)).select("vec_id", *[_six(x).alias(f"w{i}") for i, x in enumerate(vectors.loss_weights(*d))])


@query
def clamp_linf(spark, sf_dir):
    moved = vectors.project_linf(F.col("embedding"), F.col("query"), 0.03)
    return _against(spark, sf_dir, 3).select("vec_id", *_digest(moved))


@query
def signed_step(spark, sf_dir):
    moved = vectors.signed_step(F.col("embedding"), F.col("query"), 0.0313, 100)
    return _against(spark, sf_dir, 3).select("vec_id", *_digest(moved))


@query
def max_abs_diff(spark, sf_dir):
    shift = vectors.max_shift(F.col("embedding"), F.col("query"))
    return _against(spark, sf_dir, 3).select("vec_id", _six(shift).alias("shift"), (shift <= vectors.linf_bound(0.25)).alias("within"))


@query
def channel_normalise(spark, sf_dir):
    """All components, taken as pixels of three channels in turn."""
    v = F.slice(F.col("embedding"), 1, 63)
    out = vectors.standardised(v, list(im.IMAGENET_MEAN) * 21, list(im.IMAGENET_STD) * 21)
    return _vectors(spark, sf_dir).where(F.size("embedding") == 64).select("vec_id", *_digest(out))


@query
def trace_sample(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    both = rows.select("conv_id", "turn").join(last, "conv_id")
    return both.where(vectors.traced(F.col("turn"), F.col("last"))).select("conv_id", "turn")


@query
def psnr_pairs(spark, sf_dir):
    """PSNR of vectors as pixel rows against one of them."""
    rows = _against(spark, sf_dir, 3)
    diff = F.zip_with(vectors.doubles(F.col("embedding")), vectors.doubles(F.col("query")), lambda x, y: (x - y) * (x - y) * F.lit(65025.0))
    mse = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x) / F.size("embedding")
    return rows.select("vec_id", _six(psnr_of(mse)).alias("psnr"))


@query
def ssim_pairs(spark, sf_dir):
    """Structural similarity of vectors, shown as 8 x 8 planes of bytes, to one of them."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        plane = lambda v: np.clip(np.floor((np.asarray(v, np.float64) + 0.5) * 255), 0, 255).reshape(8, 8)
        return pd.Series([ssim(plane(x), plane(y)) for x, y in zip(a, b)])

    whole = (F.size("embedding") == 64) & (F.size("query") == 64)
    return _against(spark, sf_dir, 3).where(whole).select("vec_id", _six(similarity("embedding", "query")).alias("ssim"))


@query
def job_outcomes(spark, sf_dir):
    rows = ledger.images(spark, sf_dir).where("ssim_score is not null")
    return rows.select("id", outcome(F.col("ssim_score"), F.when(F.col("id") % 9 == 0, "broken")).alias("status"))


# ---- hashes


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of four images of every vector, in two halves: plain, brighter, of less contrast, and a copy."""
    v = vectors.doubles(F.col("embedding"))
    edits = F.array(v, F.transform(v, lambda x: x + F.lit(12 / 255)), F.transform(v, lambda x: x * F.lit(0.8)), v)
    shown = _vectors(spark, sf_dir).where(F.size("embedding") == 64).select("vec_id", F.posexplode(edits).alias("e", "embedding"))
    images = perceptual.plane_images(shown.select((F.col("vec_id") * 4 + F.col("e")).alias("vec_id"), "embedding"))
    hi, lo = hashmatch.halves(F.col("phash"))
    return perceptual.image_hashes(images, "id", {}).select("id", hi.alias("hi"), lo.alias("lo"))


@query
def hash_shape(spark, sf_dir):
    h = F.substring(F.md5(F.col("text")), 1, 16)
    odd = F.when(F.col("doc_id") % 3 == 0, F.upper(h)).when(F.col("doc_id") % 3 == 1, F.substring(h, 1, 15)).otherwise(h)
    return _table(spark, sf_dir, "documents").select("doc_id", hashmatch.well_formed(odd).alias("well_formed"))


@query
def hash_dedupe(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    entries = docs.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("lang")).alias("hash_kind"),
        F.when(F.col("doc_id") % 13 != 0, F.substring(F.md5("text"), 1, 16)).alias("phash"),
    )
    held = entries.where("id < 20").select("hash_kind", "phash")
    return hashmatch.dedupe(entries, held)


@query
def known_hashes(spark, sf_dir):
    rows = _hashes(spark, sf_dir)
    return membership.known(rows, rows.where("id % 10 = 0").select("lo"), "lo").select("id")


@query
def known_by_bloom(spark, sf_dir):
    """The same through a Bloom filter of two generations as a first sieve: what it lets through is joined."""
    rows = _hashes(spark, sf_dir)
    held = rows.where("id % 10 = 0").select("id", "lo")
    sizing = membership.Sizing.of(200_000)
    bits = membership.merge(membership.build(held.where("id % 20 = 0"), "lo", sizing), membership.build(held.where("id % 20 != 0"), "lo", sizing))
    likely = membership.probe(rows.select("id", "lo"), "lo", bits, sizing).where("might_contain")
    return membership.known(likely, held, "lo").select("id")


@query
def hash_candidates(spark, sf_dir):
    """Whole image, then crops, each once; some crops are equal to others or absent."""
    h = F.md5(F.col("text"))
    crops = [F.when(F.col("doc_id") % 3 == 0, F.substring(h, 1, 8)).otherwise(F.substring(h, 9, 8)), F.when(F.col("doc_id") % 2 == 0, F.substring(h, 17, 8)), F.substring(h, 9, 8)]
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(hashmatch.candidates(F.substring(h, 1, 8), *crops), ",").alias("candidates"))


@query
def hamming_pairs(spark, sf_dir):
    return hashmatch.near_pairs(_hashes(spark, sf_dir), 2)


@query
def hamming_banded(spark, sf_dir):
    return hashmatch.near_pairs(_hashes(spark, sf_dir), 4)


@query
def hamming_classes(spark, sf_dir):
    return hashmatch.classes(_hashes(spark, sf_dir))


# ---- pixels


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a gray image of 8 x 8."""
    return perceptual.plane_images(_vectors(spark, sf_dir))


def _colours(spark: SparkSession, sf_dir: str, offset: int = 0) -> DataFrame:
    """Three vectors in a row as the channels of a colour image of 8 x 8: id, pixels; ``offset`` takes the channels from later vectors."""

    @F.pandas_udf("binary")
    def woven(b: pd.Series, g: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([np.stack([np.frombuffer(x, np.uint8) for x in xs], axis=1).tobytes() for xs in zip(b, g, r)])

    at = F.col("id") - offset
    planes = _planes(spark, sf_dir).select(F.floor(at / 3).cast("long").alias("image"), F.pmod(at, F.lit(3)).alias("channel"), "pixels")
    three = planes.groupBy("image").agg(*[F.max(F.when(F.col("channel") == c, F.col("pixels"))).alias(f"c{c}") for c in range(3)])
    return three.where("c0 is not null and c1 is not null and c2 is not null").select(F.col("image").alias("id"), woven("c0", "c1", "c2").alias("pixels"))


def _as_image(pixels, side: int, channels: int):
    return F.struct(pixels.alias("pixels"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(channels).alias("channels"))


@query
def image_phash(spark, sf_dir):
    """The hashes of every plane and of its crops, each once."""
    return perceptual.image_hashes(_planes(spark, sf_dir), "id").select("id", "place", "hash_kind", "phash")


@query
def gray_planes(spark, sf_dir):
    """Gray values of colour images: their sum and one weighted by place."""

    @F.pandas_udf("array<double>")
    def grayed(data: pd.Series) -> pd.Series:
        return pd.Series([im.gray(im.pixels(d, 8, 8, 3)).ravel().astype(float) for d in data])

    return _colours(spark, sf_dir).select("id", *_digest(grayed("pixels")))


@query
def unit_planes(spark, sf_dir):
    """Colour images as red, green and blue planes of numbers from 0 to 1."""

    @F.pandas_udf("array<double>")
    def units(data: pd.Series) -> pd.Series:
        return pd.Series([im.to_unit(im.pixels(d, 8, 8, 3)).ravel().astype(float) for d in data])

    return _colours(spark, sf_dir).select("id", *_digest(F.transform(units("pixels"), lambda x: half_up(x * 255, 3))))


@query
def quality_colour(spark, sf_dir):
    """Similarity and noise of each colour image against the one whose channels start a vector later."""
    a, b = _colours(spark, sf_dir), _colours(spark, sf_dir, 1).withColumnRenamed("pixels", "other")
    judged = im.quality_by(colour=True)(_as_image(F.col("pixels"), 8, 3), _as_image(F.col("other"), 8, 3))
    return a.join(b, "id").select("id", judged.alias("q")).select("id", _six(F.col("q.ssim")).alias("ssim"), _six(F.col("q.psnr")).alias("psnr"))


@query
def quality_unreadable(spark, sf_dir):
    """Gray similarity to the next plane; each fifth file can't be read and scores nothing."""
    rows = _planes(spark, sf_dir)
    nxt = rows.select((F.col("id") - 1).alias("id"), F.col("pixels").alias("other"))
    broken = F.col("id") % 5 == 0
    other = F.struct(F.when(broken, F.lit(b"")).otherwise(F.col("other")).alias("pixels"), *[F.when(broken, -1).otherwise(8).alias(n) for n in ("height", "width")], F.lit(1).alias("channels"))
    judged = im.quality_udf(_as_image(F.col("pixels"), 8, 1), other)
    return rows.join(nxt, "id").select("id", judged.alias("q")).select("id", _six(F.col("q.ssim")).alias("ssim"), _six(F.col("q.psnr")).alias("psnr"))


def _resampled(spark: SparkSession, sf_dir: str, method: str, height: int, width: int) -> DataFrame:
    @F.pandas_udf("array<double>")
    def shown(data: pd.Series) -> pd.Series:
        return pd.Series([im.RESIZE[method](im.pixels(d, 8, 8, 1)[:, :, 0], height, width).ravel() for d in data])

    return _planes(spark, sf_dir).select("id", *_digest(shown("pixels")))


@query
def bilinear_planes(spark, sf_dir):
    return _resampled(spark, sf_dir, "bilinear", 5, 12)


@query
def lanczos_planes(spark, sf_dir):
    """Planes shrunk along columns and stretched along rows."""
    return _resampled(spark, sf_dir, "lanczos", 5, 12)


@query
def benchmark_pairs(spark, sf_dir):
    """Each colour image against a darker copy of it: similarity of all channels, largest shift, and whether that is within the bound."""
    a = _colours(spark, sf_dir)

    @F.pandas_udf("binary")
    def darker(data: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(d, np.uint8) // 16 * 15).tobytes() for d in data])

    judged = im.compare_udf(_as_image(F.col("pixels"), 8, 3), _as_image(darker("pixels"), 8, 3))
    rows = a.select("id", judged.alias("q"))
    return rows.select("id", _six(F.col("q.ssim")).alias("ssim"), _six(F.col("q.shift")).alias("shift"), (F.col("q.shift") <= vectors.linf_bound(0.1)).alias("within"))


@query
def image_files(spark, sf_dir):
    """Planes through files: written as PNG, listed with their sizes, their headers read, and decoded again.

    A row group holds many small vectors, so rows are dealt anew before they are written.  Over 32 folders Spark lists side by side; it reads 32
    small files in a task, and those tasks are joined, as each starts Python and writes a file of the result.
    """
    filesink.register(spark)
    folder = files.scratch(spark, "images")
    tasks = max(64, 4 * spark.sparkContext.defaultParallelism)
    images = _planes(spark, sf_dir).repartition(tasks, "id")
    images.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), "pixels", "height", "width", "channels").write.format(filesink.PNG).mode("append").save(folder)

    @F.pandas_udf("array<double>")
    def values(data: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, np.uint8).astype(float) for d in data])

    number = F.regexp_extract("path", r"p(\d+)\.png$", 1).cast("long")
    back = files.decoded(spark, folder).coalesce(tasks)
    return back.select(number.alias("id"), "width", "height", "channels", *_digest(values("pixels")), (F.col("length") > 0).alias("held"))


@query
def augment_boxes(spark, sf_dir):
    """Crop boxes and blurs of every image for three iterations."""
    boxes = crop_boxes(ledger.images(spark, sf_dir).select("id", "height", "width"), 3)
    return boxes.withColumn("sigma", _six(F.col("sigma")))


# ---- matching


@query
def vector_range_search(spark, sf_dir):
    """All vectors below a distance of every twentieth vector."""
    rows = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = rangesearch.vector_search(rows.where("id % 20 = 0"), rows.where("id % 20 != 0"), 1.2)
    return found.select("q_id", "id", _six(F.col("distance")).alias("distance"))


@query
def match_cascade(spark, sf_dir):
    """Suspect images against a library, by hashes of whole images, of regions, and by the nearest vector.

    Of every sixty vectors three are left out of the library and stand for suspects: one shows the next image brighter, one a quarter of it cut
    away, and one nothing of the library, so that only its vector can tell.
    """
    rows = _vectors(spark, sf_dir).where(F.size("embedding") == 64)
    library = rows.where("vec_id % 20 != 0")
    stored = perceptual.image_hashes(perceptual.plane_images(library), "id")
    shown = rows.where("vec_id % 20 = 1").select((F.col("vec_id") - 1).alias("vec_id"), vectors.doubles(F.col("embedding")).alias("embedding"))
    brighter = shown.where("vec_id % 60 = 0").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(20 / 255)))
    corner = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.element_at("embedding", F.floor(i / 6).cast("int") * 8 + i % 6 + 1))
    cut = shown.where("vec_id % 60 = 20").withColumn("embedding", corner)
    other = rows.where("vec_id % 60 = 40").select("vec_id", F.reverse(vectors.doubles(F.col("embedding"))).alias("embedding"))
    suspects = perceptual.plane_images(brighter.unionByName(other)).unionByName(perceptual.plane_images(cut, 6))
    asked = perceptual.image_hashes(suspects, "id")

    def near(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
        hashed = lambda df: df.select("id", *[h.alias(n) for h, n in zip(hashmatch.halves(F.col("phash")), ("hi", "lo"))])
        return hashmatch.search(hashed(a), hashed(b), most)

    whole = near(asked.where("place = 0"), stored.where("place = 0"), 6)
    region = near(asked, stored, 2)
    as_vectors = lambda df: df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    faces = rangesearch.vector_search(as_vectors(rows.where("vec_id % 20 = 0")), as_vectors(library), 1.25)
    found = hashmatch.cascade(("whole", whole), ("region", region), ("vector", faces))
    return found.select("q_id", "id", half_up(F.col("distance"), 3).alias("distance"), "method")


# ---- queue


@query
def queue_schedule(spark, sf_dir):
    """When every image's job begins and ends in eight lanes that work one at a time, and how it ends."""
    jobs = ledger.images(spark, sf_dir).select(
        (F.col("user_id") % 8).alias("lane"), "id", (F.unix_date(F.col("created_at").cast("date")).cast("long") * 86_400_000).alias("submitted_ms"),
        (F.col("id") % 30_000_000).cast("long").alias("work_ms"), "ssim_score", F.col("error_message").alias("error"),
    )
    return schedule(jobs)
