"""Scene tables over the star-schema test tables. One SQL text states each view for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBJECTS = """SELECT CAST(p_partkey AS BIGINT) AS obj_id, split_part(p_name, ' ', 2) AS category, split_part(p_name, ' ', 1) AS attr,
CAST((p_partkey * 7919) % 997 AS DOUBLE) / 100 AS cx, CAST((p_partkey * 104729) % 991 AS DOUBLE) / 100 AS cy, CAST((p_partkey * 1299709) % 251 AS DOUBLE) / 100 AS cz,
CAST(p_size AS DOUBLE) / 50 AS ex, CAST(p_size % 7 + 1 AS DOUBLE) / 10 AS ey, CAST(p_size % 5 + 1 AS DOUBLE) / 10 AS ez FROM {part}"""

DETECTIONS = """SELECT CAST(l_partkey AS BIGINT) AS obj_id, CAST(l_orderkey % 400 AS BIGINT) AS view_id, CAST(l_orderkey AS BIGINT) AS seq_major, CAST(l_linenumber AS INT) AS seq_minor,
1.0 - CAST(l_discount AS DOUBLE) AS conf, CAST((l_partkey * 31 + l_orderkey * 17) % 1000 AS DOUBLE) AS x1, CAST((l_partkey * 13 + l_orderkey * 7) % 500 AS DOUBLE) AS y1,
CAST((l_partkey * 31 + l_orderkey * 17) % 1000 AS DOUBLE) + l_quantity * 6 AS x2, CAST((l_partkey * 13 + l_orderkey * 7) % 500 AS DOUBLE) + l_quantity * 4 AS y2,
l_quantity * l_quantity * 12 AS pixel_area FROM {lineitem}"""

POSES = """SELECT view_id, CAST(view_id % 20 AS DOUBLE) / 2 AS px, CAST((view_id - view_id % 20) AS DOUBLE) / 40 AS py, CAST(1.2 AS DOUBLE) AS pz,
CASE view_id % 4 WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.6 AS DOUBLE) WHEN 2 THEN CAST(-0.8 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS fwx,
CASE view_id % 4 WHEN 0 THEN CAST(0.0 AS DOUBLE) WHEN 1 THEN CAST(0.8 AS DOUBLE) WHEN 2 THEN CAST(0.6 AS DOUBLE) ELSE CAST(-1.0 AS DOUBLE) END AS fwy,
CAST(0.0 AS DOUBLE) AS fwz FROM (SELECT DISTINCT CAST(l_orderkey % 400 AS BIGINT) AS view_id FROM {lineitem}) v"""

TRAJECTORY = """SELECT CAST(user_id AS BIGINT) AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_id,
event_type, CAST(event_id % 101 AS DOUBLE) / 10 AS px, CAST(event_id % 89 AS DOUBLE) / 10 AS py FROM {events}"""

POINTS = """SELECT CAST(l_partkey AS BIGINT) AS obj_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pt, CAST(l_orderkey % 400 AS BIGINT) AS view_id,
CAST((l_partkey * 7919) % 997 AS DOUBLE) / 100 + CAST((l_orderkey * 13 + l_linenumber * 7) % 41 - 20 AS DOUBLE) / 100 AS x,
CAST((l_partkey * 104729) % 991 AS DOUBLE) / 100 + CAST((l_orderkey * 17 + l_linenumber * 5) % 37 - 18 AS DOUBLE) / 100 AS y,
CAST((l_partkey * 1299709) % 251 AS DOUBLE) / 100 + CAST((l_orderkey * 19 + l_linenumber * 3) % 31 - 15 AS DOUBLE) / 100 AS z,
1 + CAST((l_orderkey + l_linenumber) % 100 AS DOUBLE) / 10 AS depth FROM {lineitem}"""

FEATURES = "SELECT CAST(vec_id AS BIGINT) AS obj_id, CAST(embedding AS {array}) AS feat, CAST(label AS INT) AS region FROM {embeddings}"

VIEWS = {"objects": (OBJECTS, "part"), "detections": (DETECTIONS, "lineitem"), "poses": (POSES, "lineitem"), "trajectory": (TRAJECTORY, "events"), "features": (FEATURES, "embeddings"), "points": (POINTS, "lineitem")}


def scene(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scene view as a DataFrame over the parquet tables in ``sf_dir``."""
    text, table = VIEWS[name]
    return spark.sql(text.replace("{array}", "array<double>"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def duckdb_views(*names: str) -> str:
    """The WITH clause that states scene views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][0].replace('{array}', 'DOUBLE[]').replace('{' + VIEWS[n][1] + '}', VIEWS[n][1])})" for n in names) + " "
