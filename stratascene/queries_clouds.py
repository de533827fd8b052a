"""Queries on the points of objects: clusters by density, clean clouds, oriented boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import density, principal
from .registry import query
from .registry import rounded as _r
from .sources.adapters import scene

_EPS, _LEAST = 0.12, 4


def _clusters(source: str) -> str:
    """CTEs up to ``labelled`` (the rows of ``source`` with their cluster, null for noise)."""
    return f"""spots AS MATERIALIZED (SELECT *, row_number() OVER () AS node FROM (SELECT obj_id, x, y, z, count(*) AS w, min(pt) AS pt FROM {source} GROUP BY ALL)),
near AS MATERIALIZED (SELECT a.node AS a, b.node AS b, b.w, a.pt, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, b.pt AS ptb FROM spots a JOIN spots b ON a.obj_id = b.obj_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {_EPS} * {_EPS}),
core AS MATERIALIZED (SELECT a AS node, pt FROM near GROUP BY a, pt HAVING sum(w) >= {_LEAST}),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)),
reach AS (SELECT node, node AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
named AS (SELECT node, min(pt) OVER (PARTITION BY root) AS cluster FROM roots JOIN core USING (node)),
border AS (SELECT a AS node, arg_min(cluster, (d2, ptb)) AS cluster FROM near JOIN named ON named.node = b WHERE a NOT IN (SELECT node FROM core) GROUP BY a),
labelled AS (SELECT s.*, cluster FROM {source} s LEFT JOIN (SELECT obj_id, x, y, z, cluster FROM spots JOIN (FROM named UNION ALL FROM border) USING (node)) f ON s.obj_id = f.obj_id AND s.x = f.x AND s.y = f.y AND s.z = f.z)"""


@query("density_clusters", f"RECURSIVE, {_clusters('points')} SELECT obj_id, pt, view_id, cluster FROM labelled", "points")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every point among those of its object."""
    return density.dbscan(scene(spark, sf_dir, "points"), _EPS, _LEAST).select("obj_id", "pt", "view_id", "cluster")


@query(
    "denoised_points",
    f"""RECURSIVE, voxels AS (SELECT obj_id, min(pt) AS pt, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM points GROUP BY obj_id, floor(x / 0.05), floor(y / 0.05), floor(z / 0.05)),
{_clusters('voxels')},
largest AS (SELECT obj_id, n, cluster FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY n DESC, cluster) AS r FROM (SELECT obj_id, cluster, count(*) AS n FROM labelled WHERE cluster IS NOT NULL GROUP BY ALL)) WHERE r = 1),
clean AS (SELECT l.* FROM labelled l LEFT JOIN largest g ON g.obj_id = l.obj_id AND g.n >= 5 WHERE g.cluster IS NULL OR g.cluster = l.cluster),
enough AS (SELECT obj_id FROM clean GROUP BY obj_id HAVING count(*) >= 4)
SELECT obj_id, pt, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM (SELECT obj_id, pt, x, y, z FROM clean WHERE obj_id IN (FROM enough) UNION ALL SELECT obj_id, pt, x, y, z FROM points WHERE obj_id NOT IN (FROM enough))""",
    "points",
)
def denoised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point a voxel, of each object's largest cluster."""
    return density.denoised(scene(spark, sf_dir, "points"), 0.05, _EPS, _LEAST).select("obj_id", "pt", *(_r(c, c) for c in "xyz"))


_COV = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query(
    "upright_boxes",
    f""", c AS (SELECT obj_id, count(*) AS n, {_COV} FROM points GROUP BY obj_id), t AS (SELECT obj_id, n, CASE WHEN n < 4 THEN 0.0 ELSE atan2(2 * xy, xx - yy) / 2 END AS yaw FROM c)
SELECT obj_id, n, round(yaw, 6) AS yaw, round(max(cos(yaw) * x + sin(yaw) * y) - min(cos(yaw) * x + sin(yaw) * y), 6) AS ex, round(max(cos(yaw) * y - sin(yaw) * x) - min(cos(yaw) * y - sin(yaw) * x), 6) AS ey, round(max(z) - min(z), 6) AS ez,
       round(cos(yaw) * (max(cos(yaw) * x + sin(yaw) * y) + min(cos(yaw) * x + sin(yaw) * y)) / 2 - sin(yaw) * (max(cos(yaw) * y - sin(yaw) * x) + min(cos(yaw) * y - sin(yaw) * x)) / 2, 5) AS cx
FROM points JOIN t USING (obj_id) GROUP BY obj_id, n, yaw""",
    "points",
)
def upright_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes about objects' points, turned about the vertical along the direction of most variance."""
    return principal.oriented_boxes(scene(spark, sf_dir, "points"), upright=True).select("obj_id", "n", *(_r(c, c) for c in ("yaw", "ex", "ey", "ez")), _r("cx", "cx", 5))


def _vector(value: str, rows: str = "xx xy xz xy yy yz xz yz zz") -> str:
    """The eigenvector in SQL, as in the closed form."""
    m = [f"({n} - {value})" if k in (0, 4, 8) else n for k, n in enumerate(rows.split())]
    a, b, c = m[:3], m[3:6], m[6:]
    cross = lambda p, q: f"[{p[1]} * {q[2]} - {p[2]} * {q[1]}, {p[2]} * {q[0]} - {p[0]} * {q[2]}, {p[0]} * {q[1]} - {p[1]} * {q[0]}]"
    return f"list_transform([list_reduce([{cross(a, b)}, {cross(a, c)}, {cross(b, c)}], lambda p, q: CASE WHEN list_dot_product(q, q) > list_dot_product(p, p) THEN q ELSE p END)], lambda v: list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))))[1]"


@query(
    "principal_boxes",
    f""", c AS (SELECT obj_id, count(*) AS n, {_COV} FROM points GROUP BY obj_id HAVING count(*) >= 4),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
g AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3)))) / 3 AS g FROM p),
e AS (SELECT *, q + 2 * p * cos(g) AS a, q + 2 * p * cos(g + 2 * pi() / 3) AS b FROM g),
v AS (SELECT obj_id, n, {_vector('a')} AS u, {_vector('b')} AS w FROM e),
s AS (SELECT obj_id, n, u, w, [w[2] * u[3] - w[3] * u[2], w[3] * u[1] - w[1] * u[3], w[1] * u[2] - w[2] * u[1]] AS v FROM v),
r AS (SELECT obj_id, n, u[1] * x + u[2] * y + u[3] * z AS a, v[1] * x + v[2] * y + v[3] * z AS b, w[1] * x + w[2] * y + w[3] * z AS c FROM points JOIN s USING (obj_id))
SELECT obj_id, n, round(max(a) - min(a), 4) AS ex, round(max(b) - min(b), 4) AS ey, round(max(c) - min(c), 4) AS ez FROM r GROUP BY obj_id, n
UNION ALL SELECT obj_id, count(*), round(max(x) - min(x), 4), round(max(y) - min(y), 4), round(max(z) - min(z), 4) FROM points GROUP BY obj_id HAVING count(*) < 4""",
    "points",
)
def principal_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes about objects' points along their principal axes, the longest first; along the axes of space below four points."""
    return principal.oriented_boxes(scene(spark, sf_dir, "points")).select("obj_id", "n", *(_r(c, c, 4) for c in ("ex", "ey", "ez")))
