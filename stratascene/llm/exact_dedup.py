"""Exact deduplication on a log-structured merge index of text digests.

Level 0 holds *runs*: each task of the scan is a memtable that flushes its (digest, id) entries sorted by digest, as
Parquet files that carry a Bloom filter on the digest. *Compaction* merges the runs into level 1, one entry per digest
with the surviving identifier and the count; partial aggregation shrinks a hot digest to one row per task before the
shuffle. Entries with a count above one are *hits*. Their texts are compared byte by byte: a grouping on (digest, bytes)
tells whether a digest stands for one text, and a digest that stands for several is split by its bytes.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_name, ship_package, small_batches, stage_table
from .filters import filter_of, passes


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _digest(data: bytes, bits: int) -> str:
    return hashlib.sha256(data).hexdigest()[: bits // 4]


def _entries(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            full = [hashlib.sha256(normalise(x.as_py())).hexdigest() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[: bits // 4] for x in full], pa.string()), pa.array(full, pa.string())], ["id", "digest", "text_sha256"])

    return run


def _key(digest: str) -> int:
    return int(digest[:15], 16)


def _texts_of_hits(bits: int, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data = [normalise(x.as_py()) for x in batch.column(1)]
            found = [_digest(x, bits) for x in data]
            hit = np.flatnonzero(passes(np.array([_key(x) for x in found], dtype=np.int64), words.value)).tolist()
            ids, digests, texts = batch.column(0).take(pa.array(hit, pa.int64())).to_pylist(), [found[k] for k in hit], [data[k] for k in hit]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary())], ["id", "digest", "body"])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest_bits: int = 256) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are after lower-casing A-Z; null equals empty. ``keep`` names the identifier that
    stays, ``"max"`` or ``"min"``; a null identifier stays only where the group has no other. Rows that repeat the
    surviving identifier within a group are all marked kept (``drop_copies`` leaves one of them). An empty table gives an empty
    table. Other columns are ignored, whatever their names. ``digest_bits`` below 256 forces collisions, for tests.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    best = F.max if keep == "max" else F.min
    runs = stage_table(
        slim.mapInArrow(_entries(digest_bits), "id long, digest string, text_sha256 string").sortWithinPartitions("digest", "id"),
        "runs", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"},
    )
    level1 = stage_table(runs.groupBy("digest").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "level1")
    hits = level1.where("group_size > 1")
    words = filter_of(hits.select(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("key")))
    bodies = slim.mapInArrow(_texts_of_hits(digest_bits, words), "id long, digest string, body binary")
    verified = stage_table(bodies.groupBy("digest", "body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "collisions")
    if verified.isEmpty():
        groups = runs.join(level1, "digest")
    elif digest_bits >= 256:
        raise ValueError("two different texts share a SHA-256 digest")
    else:  # a digest of several texts: the full hash of the normalised bytes tells them apart
        exact = runs.join(verified, "digest", "left_semi")
        split = exact.groupBy("digest", "text_sha256").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = runs.join(verified, "digest", "left_anti").join(level1, "digest").select("id", "text_sha256", "keep_id", "group_size").unionByName(exact.join(split, ["digest", "text_sha256"]).select("id", "text_sha256", "keep_id", "group_size"))
    return groups.select("id", "keep_id", "group_size", F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, one for each group of equal texts, all columns unchanged.

    Only identifiers travel to the join; a text is hashed again only where its identifier has a dropped row. Repeated rows
    of one identifier and text leave one row. Null and empty texts are one group; extra columns may have any name; an empty table gives
    an empty table.
    """
    groups = stage_table(exact_groups(docs, id_col, text_col, keep), "groups")
    key, gone, sha = (new_name(docs, x) for x in ("key", "gone", "sha"))
    out = groups.where("NOT kept").groupBy(F.col("id").alias(key)).agg(F.collect_set("text_sha256").alias(gone))
    own = docs[id_col].cast("long").eqNullSafe(F.col(key))
    digest = F.sha2(F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256)
    left = docs.join(out, own, "left").where(F.when(F.col(gone).isNull(), F.lit(True)).otherwise(~F.array_contains(gone, digest))).select(*docs.columns)
    again = groups.where("kept").groupBy(F.col("id").alias(key), F.col("text_sha256").alias(sha)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return left
    marked = left.join(again, left[id_col].cast("long").eqNullSafe(F.col(key)) & (F.sha2(F.translate(F.coalesce(left[text_col].cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256) == F.col(sha)), "left")
    single = marked.where(F.col(sha).isNull()).select(*docs.columns)
    return single.unionByName(marked.where(F.col(sha).isNotNull()).dropDuplicates([key, sha]).select(*docs.columns))
