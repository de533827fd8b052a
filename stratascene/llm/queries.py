"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import token_digests
from .chaining import document_passages
from .common import read_table, shared_path
from .exact_dedup import exact_groups
from .interaction import audit_filters
from .licenses import TEMPLATES, scan_licenses, stride_of, words_of
from .merkle import fingerprints
from .minhash import near_duplicate_groups
from .mixing import mix_sources
from .negatives import hard_negatives
from .packing import bpe_ids, pack_documents, read_packs, write_packs
from .suffix import repeated_spans
from .toxicity import fit_toxicity, held_out, score_toxicity
from .warc import archive_digests


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op3_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_passages(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(read_table(spark, sf_dir, "pages"))


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = bpe_ids(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    root = shared_path(spark, "packing")
    write_packs(pack_documents(read_table(spark, sf_dir, "documents"), encode=encode), root)
    return read_packs(spark, root).select("pack_id", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "position_resets", F.sha2("input_ids", 256).alias("ids_sha256"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"), n=2).withColumnRenamed("id", "doc_id")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_digests(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("id") % 50 == 0)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("matches").withColumnRenamed("id", "doc_id")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_toxicity": op2_toxicity, "op3_collinear_chaining": op3_collinear_chaining, "op4_warc_archive": op4_warc_archive, "op5_token_packing": op5_token_packing, "op6_merkle_fingerprints": op6_merkle_fingerprints, "op7_exact_dedup": op7_exact_dedup, "op8_minhash_near_dedup": op8_minhash_near_dedup, "op9_mix_sources": op9_mix_sources, "op10_byte_bpe": op10_byte_bpe, "op11_filter_audit": op11_filter_audit, "op12_hard_negatives": op12_hard_negatives, "op13_license_scan": op13_license_scan}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (
    SELECT page_id, body, octet_length(body) AS n, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM g
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n FROM documents),
e AS (
    SELECT doc_id, n, body,
           coalesce(lead(body) OVER (ORDER BY doc_id DESC), first_value(body) OVER (ORDER BY doc_id DESC)) AS nxt
    FROM d),
t AS (
    SELECT doc_id, n, body, nxt, substring(body, 1, n - n // 3) || CASE WHEN n // 3 > 0 THEN substring(nxt, 1, n // 3) ELSE '' END AS edited FROM e),
every AS (SELECT doc_id, 1 AS which, body AS x FROM t UNION ALL SELECT doc_id, 2, edited FROM t UNION ALL SELECT doc_id, 3, nxt FROM t),
tree AS (
    SELECT doc_id, which, list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
           lambda p: list_transform(regexp_extract_all(p, '(?s).{1,32}'), lambda y: sha256(y)))) AS secs
    FROM every),
nodes AS (
    SELECT doc_id, which, list_transform(secs, lambda s: list_transform(s, lambda p: {'n': sha256(array_to_string(p, '')), 'm': array_to_string(list_transform(p, lambda y: y[1:4]), '')})) AS secs
    FROM tree),
tops AS (
    SELECT doc_id, which, secs, list_transform(secs, lambda s: sha256(array_to_string(list_transform(s, lambda p: p.n), ''))) AS sn FROM nodes),
prints AS (
    SELECT doc_id, which, secs, sha256(array_to_string(sn, '')) || '|' || array_to_string(list_transform(secs, lambda s, i: sn[i][1:16] || ':' || array_to_string(list_transform(s, lambda p: p.n[1:16] || '=' || p.m), '.')), '/') AS f
    FROM tops),
branches AS (
    SELECT doc_id, which, s, p, secs[s][p].n AS n
    FROM (SELECT doc_id, which, secs, s, unnest(range(1, len(secs[s]) + 1)) AS p FROM (SELECT doc_id, which, secs, unnest(range(1, len(secs) + 1)) AS s FROM prints WHERE which < 3))),
changed AS (
    SELECT doc_id, count(*) AS c
    FROM (SELECT doc_id, s, p, n FROM branches WHERE which = 1) a FULL JOIN (SELECT doc_id, s, p, n FROM branches WHERE which = 2) b USING (doc_id, s, p)
    WHERE a.n IS DISTINCT FROM b.n GROUP BY doc_id),
marks AS (
    SELECT doc_id, which, f, flatten(list_transform(secs, lambda s: list_transform(s, lambda p: p.m))) AS ps FROM prints),
pieces AS (
    SELECT doc_id, which, p, k, ps[p][4 * k - 3 : 4 * k] AS m
    FROM (SELECT doc_id, which, ps, p, unnest(range(1, len(ps[p]) // 4 + 1)) AS k FROM (SELECT doc_id, which, ps, unnest(range(1, len(ps) + 1)) AS p FROM marks))),
totals AS (SELECT doc_id, which, count(*) AS c FROM pieces GROUP BY ALL),
same AS (SELECT a.doc_id, b.which, count(*) AS c FROM pieces a JOIN pieces b ON a.doc_id = b.doc_id AND a.which = 1 AND b.which > 1 AND a.p = b.p AND a.k = b.k AND a.m = b.m GROUP BY ALL),
near AS (
    SELECT a.doc_id, b.which,
           CASE WHEN string_split(a.f, '|')[1] = string_split(b.f, '|')[1] THEN 1.0::DOUBLE
                WHEN greatest(coalesce(x.c, 0), coalesce(y.c, 0)) = 0 THEN 0.0::DOUBLE
                ELSE coalesce(s.c, 0)::DOUBLE / greatest(coalesce(x.c, 0), coalesce(y.c, 0)) END AS v
    FROM prints a JOIN prints b ON a.doc_id = b.doc_id AND a.which = 1 AND b.which > 1
    LEFT JOIN totals x ON x.doc_id = a.doc_id AND x.which = 1 LEFT JOIN totals y ON y.doc_id = a.doc_id AND y.which = b.which
    LEFT JOIN same s ON s.doc_id = a.doc_id AND s.which = b.which)
SELECT t.doc_id, t.n::BIGINT AS n_chars, sha256(t.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, v.v AS near_edited, w.v AS near_next, coalesce(g.c, 0) AS edited_branches
FROM t LEFT JOIN changed g ON g.doc_id = t.doc_id JOIN prints a ON a.doc_id = t.doc_id AND a.which = 1 JOIN prints b ON b.doc_id = t.doc_id AND b.which = 2
JOIN near v ON v.doc_id = t.doc_id AND v.which = 2 JOIN near w ON w.doc_id = t.doc_id AND w.which = 3
"""

OP7_SQL = f"""
WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

OP8_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws
                        ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s
    FROM w),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sets s ON s.doc_id = a JOIN sets t ON t.doc_id = b
    WHERE 100 * n >= 80 * (len(s.s) + len(t.s) - n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id
"""

OP9_SQL = r"""
WITH RECURSIVE sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sizes GROUP BY source),
rounds AS (
    SELECT 0 AS n, 0::DOUBLE AS level
    UNION ALL
    SELECT n + 1, (SELECT (sum(source_size) - 3 * coalesce(sum(source_size) FILTER (r.level * weight > 3 * source_size), 0))::DOUBLE
                          / sum(weight) FILTER (r.level * weight <= 3 * source_size) FROM sources)
    FROM rounds r WHERE n < 60),
targets AS (
    SELECT source, source_size, least((SELECT max(level) FROM rounds) * weight, (3 * source_size)::DOUBLE) AS target FROM sources),
placed AS (
    SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
    FROM sizes)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END * size
        + least(greatest((CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END) - start, 0), size))::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""

OP11_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
           || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
           || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
    SELECT a.c || b.c || d.c || e.c || f.c AS o FROM letters a, letters b, letters d, letters e, letters f
    WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT o, k, o[k] AS c, CASE WHEN k = 1 THEN '' ELSE o[1 : k - 1] END AS before FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS k FROM orders)),
seen AS (
    SELECT part, o, k, n, g, x, fails, contains(fails, c) AS fail, fails <> '' AND len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AS gone FROM cells, steps)
SELECT part, o AS filter_order, k::INTEGER AS step, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fail AND length(fails) = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(g) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost,
       coalesce(sum(sum(n) FILTER (fail AND NOT gone)) OVER (PARTITION BY part, o[k]), 0)::BIGINT AS shapley
FROM seen GROUP BY part, o, k
"""

OP12_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.c, v.c)::BIGINT AS score
    FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a, v),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""

_TEMPLATES = ", ".join(f"('{t.label}', {t.exact}, {[w.decode() for w in words_of(t.text.encode())]})" for t in TEMPLATES)

OP13_SQL = rf"""
WITH t AS (SELECT label, exact, words, list_distinct(words) AS own FROM (VALUES {_TEMPLATES}) v(label, exact, words)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
blocks AS (SELECT r, list_distinct(ws[start + 1 : start + {2 * stride_of(TEMPLATES)}]) AS own FROM (SELECT r, ws, unnest(range(0, len(ws), {stride_of(TEMPLATES)})) AS start FROM d)),
notices AS (
    SELECT r, label, len(list_intersect(b.own, t.own)) / len(t.own) AS share FROM blocks b, t
    WHERE NOT exact AND 100 * len(list_intersect(b.own, t.own)) >= 80 * len(t.own)),
places AS (
    SELECT r, label, i - 1 AS place FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), t
    WHERE exact AND ws[i] = words[1] AND ws[i : i + len(words) - 1] = words),
base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
shares AS (SELECT r, max(share) AS share FROM notices GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM notices) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a AS first_word, b AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN shares USING (r) LEFT JOIN every USING (r)
"""

ORACLE_SQL = {"op4_warc_archive": OP4_SQL, "op6_merkle_fingerprints": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL, "op9_mix_sources": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_license_scan": OP13_SQL}
