"""A content-addressed WARC archive: payload bytes are stored once, record headers separately, records come back through joins.

Layout under one folder of the shared store: ``warc``, the archive itself, whose files are WARC/1.1 in gzip (one member a file); ``records``,
what was read back from it; ``payloads`` (digest, bytes), once for each digest; ``headers`` (page_id, exact header, record type, digest).
A payload is addressed by its SHA-256, which every record's header names; the bytes of one digest are compared before one copy stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, ship_package, small_batches, stage_table
from .filters import filter_of, may_have

#: Payloads of fewer bytes are never revisited.
SMALLEST_SHARED = 1000
END = "\r\n\r\n"


def _key(digest: str = "digest") -> Column:
    return F.xxhash64(digest)


def _distinct_payloads(rows: DataFrame, repeated: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``digest, payload`` of ``rows`` in two parts: rows as they are whose digest is surely not in ``repeated``, and one row for each
    different payload of the others, with the largest identifier as ``keeper``. Only the latter are shuffled, copies of a task as one.

    Equal digests of different bytes are an error.
    """
    bits = filter_of(repeated.select(_key().alias("key")))
    once = rows.where(~may_have(_key(), bits))
    many = rows.where(may_have(_key(), bits)).groupBy("digest", "payload").agg(F.max(id_col).alias("keeper"))
    many = stage_table(many, "warc-payloads")
    clash = many.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if clash:
        raise ValueError(f"different payloads have the digest {clash['digest']}")
    return once, many


def _line(rows: DataFrame, revisit: bool, date: str) -> DataFrame:
    """One record as text: ``page_id, url, digest, sha1`` and ``payload``, or for a revisit ``keeper``."""
    empty = hashlib.sha256(b"").hexdigest()
    parts = [
        F.lit("WARC/1.1\r\nWARC-Type: " + ("revisit" if revisit else "response") + "\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\nX-Payload-SHA256: "), F.col("digest"), F.lit("\r\nWARC-Block-Digest: sha256:"), F.lit(empty) if revisit else F.col("digest"),
    ]
    if revisit:
        parts += [F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">\r\nContent-Length: 0" + END)]
    else:
        parts += [F.lit("\r\nContent-Length: "), F.length("payload").cast("string"), F.lit(END), F.col("payload").cast("string")]
    return rows.select(F.concat(*parts).alias("value"))


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` under ``root``.

    The payload is the text in UTF-8, null counting as empty. Of records with equal payloads of ``SMALLEST_SHARED`` bytes or more
    the one with the largest identifier is a response, the others are revisits that refer to it; smaller ones are all
    responses. Rows that repeat that identifier with that payload are all responses. A null identifier or address is written
    as such, a null identifier refers to a response only where its group has another. Line ends in an address are percent-encoded. An
    empty table makes an empty archive. Other columns are ignored. Only payloads whose digest occurs again are shuffled.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("urn:none")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    slim = stage_table(rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.length("payload").alias("size")), "warc-digests")
    groups = slim.where(f"size >= {SMALLEST_SHARED}").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND keeper IS NOT NULL")
    groups = stage_table(groups.select("digest", "keeper"), "warc-groups")
    once, many = _distinct_payloads(rows, groups, "page_id")
    shared = slim.join(groups, "digest")
    kept = F.col("page_id").eqNullSafe(F.col("keeper"))
    carriers = shared.where(kept).join(many.select("digest", "payload"), "digest").select("page_id", "url", "digest", "sha1", "payload")
    chance = many.join(groups.select("digest"), "digest", "left_anti").select("digest", "payload")  # what only the filter took for repeated
    chance = slim.join(chance, "digest").select("page_id", "url", "digest", "sha1", "payload")
    alone = once.withColumn("sha1", F.sha1("payload")).select("page_id", "url", "digest", "sha1", "payload")
    records = _line(alone.unionByName(carriers).unionByName(chance), False, date).unionByName(_line(shared.where(~kept), True, date))
    # the text sink ends each line with the two line ends that end a WARC record
    records.write.option("lineSep", END).option("compression", "gzip").text(f"{root}/warc")


def _field(header: str, name: str) -> str | None:
    return next((x[len(name) + 2 :] for x in header.split("\r\n") if x.startswith(name + ": ")), None)


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])


_NAMES = ["page_id", "record_type", "refers_to", "header", "payload_digest", "digest", "payload"]


def _parsed(header: bytes, block: bytes) -> tuple:
    text = header.decode("utf-8", "replace")
    kind, name, strong = _field(text, "WARC-Type"), _field(text, "WARC-Record-ID"), _field(text, "X-Payload-SHA256")
    own = hashlib.sha256(block).hexdigest()
    if _field(text, "WARC-Block-Digest") != f"sha256:{own}" or kind == "response" and strong != own:
        raise ValueError(f"damaged record {name}")
    return _page(name), kind, _page(_field(text, "WARC-Refers-To")), header, _field(text, "WARC-Payload-Digest").removeprefix("sha1:"), strong, block if kind == "response" else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of archive files, which come cut at every pair of line ends, in order; the pair is put back, and lengths tell where a block ends."""
    end = END.encode()
    held, header, size = bytearray(), None, 0
    for batch in batches:
        rows = []
        for part in small_batches(iter([batch]), 0):
            for piece in part.column(0).to_pylist():
                held += piece + end
                while True:
                    if header is None:
                        while held.startswith(end):  # after the last record of a file
                            del held[: len(end)]
                        if (at := held.find(end)) < 0:
                            break
                        header = bytes(held[:at])
                        del held[: at + len(end)]
                        size = int(header.rpartition(b"Content-Length: ")[2])
                    if len(held) < size + len(end):
                        break
                    rows.append(_parsed(header, bytes(held[:size])))
                    del held[: size + len(end)]
                    header = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.binary()))], _NAMES)
    if header is not None:
        raise ValueError("an archive file ends within a record")


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """``page_id, record_type, refers_to, header, payload_digest`` (SHA-1), ``digest`` (SHA-256) of each record's full payload, and ``payload`` of responses.

    A file is a stream of pieces in one task, whatever its size. Every block is held against its digest as it is read.
    """
    ship_package(spark)
    pieces = spark.read.option("lineSep", END).text(f"{root}/warc").select(F.col("value").cast("binary"))
    return pieces.mapInArrow(_records, "page_id long, record_type string, refers_to long, header binary, payload_digest string, digest string, payload binary")


def store(records: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Write the content-addressed store under ``root``, headers and payloads, each different payload once, and read it back."""
    spark = records.sparkSession
    records.write.option("compression", "zstd").parquet(f"{root}/records")
    records = spark.read.parquet(f"{root}/records")
    records.drop("payload").write.option("compression", "zstd").parquet(f"{root}/headers")
    responses = records.where("record_type = 'response'").select("page_id", "digest", "payload")
    once, many = _distinct_payloads(responses, responses.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "page_id")
    once.select("digest", "payload").unionByName(many.select("digest", "payload")).write.option("compression", "zstd").parquet(f"{root}/payloads")
    return spark.read.parquet(f"{root}/headers"), spark.read.parquet(f"{root}/payloads")


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """The original records: ``page_id``, the exact ``header`` and the full ``payload`` of each, revisits with the payload that they refer to."""
    return headers.join(payloads, "digest").select("page_id", "header", "payload")


def archive_digests(pages: DataFrame, root: str | None = None, **columns: str) -> DataFrame:
    """Write an archive of ``pages``, read it back, and tell for each record what its full payload is.

    ``page_id, payload_bytes, payload_digest`` (bare SHA-1), ``record_type, refers_to``. Sizes and digests are computed from the stored
    payloads that were read back, once for each, and joined to the headers by SHA-256.
    """
    spark = pages.sparkSession
    root = root or shared_path(spark, "warc")
    write_archive(pages, root, **columns)
    headers, payloads = store(read_archive(spark, root), root)
    sizes = payloads.select("digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    return headers.drop("payload_digest").join(sizes, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
