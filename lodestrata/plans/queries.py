"""Registered queries over geometry derived from the test tables, and the SQL that each must equal.

Derived sources: G1 points (events), G2 lines (one for each user), G3 rectangles (orders), G4 multipolygons (part).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import expr as X
from lodestrata.functions import topology
from lodestrata.functions.geoarrow import to_ipc, to_table
from lodestrata.functions.geojson import display, feature_json, geometry_json
from lodestrata.functions.mvt import decode
from lodestrata.functions.overview import Grid, overview_parts
from lodestrata.functions.wkb import parse, to_wkb, wkb_bbox, wkb_geometry
from lodestrata.operators import assign as A
from lodestrata.operators import levels as L
from lodestrata.operators import limits as M
from lodestrata.operators import pages as P
from lodestrata.operators import stats as S
from lodestrata.operators.assign import global_rank
from lodestrata.operators.pack import chunks, pack
from lodestrata.operators.project import project
from lodestrata.operators.spatial_join import bbox_join
from lodestrata.plans import tiles as T
from lodestrata.plans.convert import Options, convert
from lodestrata.plans.validate import check
from lodestrata.sources.reader import LodFolder, LodTable
from lodestrata.sources.shared import deleted, shared_path, sort_joined, spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LADDER = (8.0, 4.0, 2.0, 1.0, 0.5)
FINE = (1.0, 0.5, 0.25, 0.125, 0.0625)
ODD_LADDER = (50.0, 17.0, 6.0, 2.1, 0.7)
BOX = (-20.0, -15.0, 40.0, 30.0)
#: The second level has no row group of its own.
LEVELS = ((0, 2, 640.0), (1, 2, 160.0), (2, 7, 40.0), (3, 12, 2.5))
TARGETS = (1e6, 640.0, 639.0, 160.0, 97.0, 40.0, 12.0, 2.5, 0.3)
LODS = (("coarse", (0, 1)), ("fine", (2, 3)))
BOXES = tuple((q, -180.0 + 60 * q, -85.0 + 20 * q, -180.0 + 60 * q + w, -85.0 + 20 * q + w) for q, w in enumerate((3.0, 10.0, 30.0, 60.0, 90.0, 500.0)))


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


# --- derived sources

G1_SQL = """g1 AS (SELECT event_id AS fid,
  cast((event_id*7919 + user_id*104729) % 36000 AS double)/100.0e0 - 180.0e0 AS x,
  cast((event_id*15487) % 17000 AS double)/100.0e0 - 85.0e0 AS y,
  value AS priority, user_id, event_type FROM events)"""
G3_SQL = """g3 AS (SELECT fid, xmin, ymin, xmin + w AS xmax, ymin + h AS ymax FROM (SELECT o_orderkey AS fid,
  cast((o_orderkey*37) % 36000 AS double)/100.0e0 - 180.0e0 AS xmin,
  cast((o_custkey*53) % 16000 AS double)/100.0e0 - 80.0e0 AS ymin,
  o_totalprice/50000.0e0/(1.0e0 + cast(o_orderkey % 16 AS double)) AS w,
  o_totalprice/80000.0e0/(1.0e0 + cast(o_custkey % 8 AS double)) AS h FROM orders) t)"""
G2_SQL = """g2 AS (SELECT user_id AS fid, ts, event_id,
  cast((user_id % 34)*10 AS double) - 170.0e0 + (1 << (user_id % 8)::INT)::DOUBLE * 0.01e0 * cast((event_id*31) % 100 AS double)/100.0e0 AS x,
  cast((user_id % 13)*10 AS double) - 60.0e0 + (1 << (user_id % 8)::INT)::DOUBLE * 0.01e0 * cast((event_id*57) % 100 AS double)/100.0e0 AS y FROM events)"""
G4_SQL = """g4 AS (SELECT p_partkey AS fid, cast((p_partkey*41) % 3500 AS double)/10.0e0 - 175.0e0 AS x0,
  cast((p_partkey*59) % 1500 AS double)/10.0e0 - 75.0e0 AS y0, cast(p_size AS double)/8.0e0 AS s, p_partkey % 3 = 0 AS has_second FROM part)"""


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "events").selectExpr(
        "event_id AS fid", "cast((event_id*7919 + user_id*104729) % 36000 AS double)/100.0D - 180.0D AS x",
        "cast((event_id*15487) % 17000 AS double)/100.0D - 85.0D AS y", "value AS priority", "user_id", "event_type",
    )


def g1_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = g1(spark, sf_dir).withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y"), "kind": F.lit(0)})
    return A.priority_rank(p, "priority")


def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = "cast(shiftleft(1, cast(user_id % 8 AS int)) AS double) * 0.01D"
    return source(spark, sf_dir, "events").selectExpr(
        "user_id AS fid", "ts", "event_id",
        f"cast((user_id % 34)*10 AS double) - 170.0D + {size} * cast((event_id*31) % 100 AS double)/100.0D AS x",
        f"cast((user_id % 13)*10 AS double) - 60.0D + {size} * cast((event_id*57) % 100 AS double)/100.0D AS y",
    )


def g2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, line): one array of points a user, in order of time."""
    points = F.array_sort(F.collect_list(F.struct("ts", "event_id", "x", "y")))
    return g2(spark, sf_dir).groupBy("fid").agg(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS fid", "cast((o_orderkey*37) % 36000 AS double)/100.0D - 180.0D AS xmin", "cast((o_custkey*53) % 16000 AS double)/100.0D - 80.0D AS ymin",
        "o_totalprice/50000.0D/(1.0D + cast(o_orderkey % 16 AS double)) AS w", "o_totalprice/80000.0D/(1.0D + cast(o_custkey % 8 AS double)) AS h",
    )
    return o.select("fid", "xmin", "ymin", (F.col("xmin") + F.col("w")).alias("xmax"), (F.col("ymin") + F.col("h")).alias("ymax"))


def box_ring(x0, y0, x1, y1):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))


def g3_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = box_ring(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    return g3(spark, sf_dir).withColumn("geometry", to_wkb(F.lit(3), F.array(F.array(ring))))


def g4_wkb(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    part = source(spark, sf_dir, "part").select("p_partkey", "p_size")
    p = (spread(part, "p_partkey") if dealt else part).selectExpr(
        "p_partkey AS fid", "cast((p_partkey*41) % 3500 AS double)/10.0D - 175.0D AS x0", "cast((p_partkey*59) % 1500 AS double)/10.0D - 75.0D AS y0",
        "cast(p_size AS double)/8.0D AS s", "p_partkey % 3 = 0 AS has_second",
    )
    x, y, s = F.col("x0"), F.col("y0"), F.col("s")
    first = F.array(box_ring(x, y, x + s, y + s), F.reverse(box_ring(x + s / 4, y + s / 4, x + s * 3 / 4, y + s * 3 / 4)))
    second = F.array(box_ring(x + s * 2, y, x + s * 3, y + s))
    parts = F.when(F.col("has_second"), F.array(first, second)).otherwise(F.array(first))
    return p.withColumn("geometry", to_wkb(F.lit(6), parts))


def values(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def sql_values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}e0" if isinstance(v, float) and "e" not in repr(v) else str(v) for v in r) + ")" for r in rows)


LEVELS_SQL = f"levels(level, row_group_end, resolution) AS (VALUES {sql_values(LEVELS)})"
BOXES_SQL = f"q(q, qx0, qy0, qx1, qy1) AS (VALUES {sql_values(BOXES)})"


def level_table(spark: SparkSession) -> DataFrame:
    return values(spark, LEVELS, "level int, row_group_end long, resolution double")


# --- filters

IN_BOX = f"(xmax >= {BOX[0]}e0 AND xmin <= {BOX[2]}e0 AND ymax >= {BOX[1]}e0 AND ymin <= {BOX[3]}e0)"


@register(f"WITH {G3_SQL} SELECT * FROM g3 WHERE {IN_BOX}")
def bbox_filter(spark, sf_dir):
    """FLT-01/FLT-09."""
    return g3(spark, sf_dir).where(X.bbox_intersects(*(F.col(c) for c in S.BOX), BOX))


@register(f"""WITH {G3_SQL}, n AS (SELECT fid, CASE WHEN fid % 17 <> 0 THEN xmin END AS xmin, ymin, xmax, CASE WHEN fid % 19 <> 0 THEN ymax END AS ymax FROM g3)
SELECT * FROM n WHERE xmin IS NULL OR ymax IS NULL OR {IN_BOX}""")
def bbox_filter_null_bounds(spark, sf_dir):
    """FLT-09/ASG-03."""
    rows = g3(spark, sf_dir).withColumns({"xmin": F.when(F.col("fid") % 17 != 0, F.col("xmin")), "ymax": F.when(F.col("fid") % 19 != 0, F.col("ymax"))})
    return rows.where(X.bbox_intersects(*(F.col(c) for c in S.BOX), BOX))


@register(f"WITH {G1_SQL} SELECT fid, x, y FROM g1 WHERE x BETWEEN {BOX[0]}e0 AND {BOX[2]}e0 AND y BETWEEN {BOX[1]}e0 AND {BOX[3]}e0")
def point_in_box(spark, sf_dir):
    """FLT-13."""
    return g1(spark, sf_dir).where(X.point_in_bbox(F.col("x"), F.col("y"), BOX)).select("fid", "x", "y")


@register(f"WITH {G3_SQL} SELECT fid, CASE WHEN xmin < -175.0e0 OR xmax > 180.0e0 THEN -180.0e0 ELSE xmin END AS xmin, greatest(ymin, -90.0e0) AS ymin, CASE WHEN xmin < -175.0e0 OR xmax > 180.0e0 THEN 180.0e0 ELSE xmax END AS xmax, least(ymax, 90.0e0) AS ymax FROM g3")
def viewport_bbox(spark, sf_dir):
    """INS-04: viewports that reach over -175 are moved over the antimeridian first."""
    west = F.when(F.col("xmin") < -175, F.col("xmin") - 10).otherwise(F.col("xmin"))
    return g3(spark, sf_dir).select("fid", X.viewport(west, F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("v")).select("fid", "v.*")


# --- levels


@register(f"""WITH {LEVELS_SQL}, t(target) AS (VALUES {sql_values([(t,) for t in TARGETS])})
SELECT target::DOUBLE AS target, s.level::INT AS level, l.row_group_end::BIGINT AS row_group_end FROM (
  SELECT target, coalesce(max(level) FILTER (WHERE resolution >= target), 0) AS level FROM t, levels GROUP BY target) s JOIN levels l USING (level)""")
def level_select(spark, sf_dir):
    """LVL-01/LVL-04."""
    return L.select_level(level_table(spark), values(spark, [(t,) for t in TARGETS], "target double"))


@register(f"""WITH {LEVELS_SQL}, s AS (SELECT *, lag(row_group_end, 1, -1) OVER (ORDER BY level) + 1 AS row_group_start FROM levels)
SELECT level::INT AS level, row_group_end::BIGINT AS row_group_end, resolution::DOUBLE AS resolution, row_group_start::BIGINT AS row_group_start, (row_group_end - row_group_start + 1)::BIGINT AS n_row_groups FROM s""")
def level_row_groups(spark, sf_dir):
    """LVL-02/LVL-03/WIN-06."""
    return L.level_row_groups(level_table(spark))


LODS_SQL = "lods(lod, level) AS (VALUES " + ", ".join(f"('{n}', {i})" for n, of in LODS for i in of) + ")"


@register(f"WITH {LEVELS_SQL}, {LODS_SQL} SELECT lod, max(row_group_end)::BIGINT AS row_group_end FROM levels JOIN lods USING (level) GROUP BY lod")
def lod_boundary(spark, sf_dir):
    """LVL-06/LVL-08/JOI-04."""
    return L.lod_boundary(level_table(spark), spark.createDataFrame([(n, list(i)) for n, i in LODS], "lod string, level_indices array<int>"))


@register(f"WITH {G1_SQL} SELECT fid, CASE WHEN fid < 100 THEN 0 WHEN fid < 700 THEN 1 WHEN fid < 3000 THEN 2 ELSE 3 END::INT AS level FROM g1")
def row_to_level(spark, sf_dir):
    """LVL-09/LVL-10/JOI-05."""
    ends = values(spark, [(0, 0, 100), (1, 100, 700), (2, 700, 3000), (3, 3000, 2**62)], "level int, row_start long, row_end long")
    return L.row_to_level(g1(spark, sf_dir).select(F.col("fid").alias("row_index")), ends).select(F.col("row_index").alias("fid"), "level")


@register("SELECT z::INT AS z, 40075016.68557849e0 / (512.0e0 * (1 << z)::DOUBLE) AS metres, round(40075016.68557849e0 / (512.0e0 * (1 << z)::DOUBLE) / 111320.0e0, 12) AS degrees FROM range(0, 18) t(z)")
def webmerc_ladder(spark, sf_dir):
    """LVL-12/LVL-13."""
    from lodestrata.sources.meta import unit_scale

    rows = values(spark, enumerate(X.web_mercator_ladder()), "z int, metres double")
    return rows.withColumn("degrees", F.round(F.col("metres") * X.lit(unit_scale("absent")), 12))


@register("""WITH t AS (SELECT z::INT AS z, x::INT AS x, y::INT AS y, (1 << z)::DOUBLE AS n FROM range(0, 5) a(z), range(0, 16) b(x), range(0, 16) c(y) WHERE x < (1 << z) AND y < (1 << z))
SELECT z, x, y, round((x - 0.015625e0) / n * 360.0e0 - 180.0e0, 9) AS xmin, round(degrees(atan(sinh(pi() * (1.0e0 - 2.0e0 * (y + 1.015625e0) / n)))), 9) AS ymin,
  round((x + 1.015625e0) / n * 360.0e0 - 180.0e0, 9) AS xmax, round(degrees(atan(sinh(pi() * (1.0e0 - 2.0e0 * (y - 0.015625e0) / n)))), 9) AS ymax,
  round(360.0e0 * cos(atan(sinh(pi() * (1.0e0 - 2.0e0 * (y + 0.5e0) / n)))) / (512.0e0 * n), 9) AS resolution FROM t""")
def tile_bounds(spark, sf_dir):
    """LVL-11."""
    side = spark.range(16)
    t = spark.range(5).select(F.col("id").cast("int").alias("z")).join(side.select(F.col("id").cast("int").alias("x")), F.expr("x < shiftleft(1, z)")).join(side.select(F.col("id").cast("int").alias("y")), F.expr("y < shiftleft(1, z)"))
    d = {c: F.col(c).cast("double") for c in ("z", "x", "y")}
    box = X.tile_bbox(d["z"], d["x"], d["y"])
    return t.select("z", "x", "y", *(F.round(box[c], 9).alias(c) for c in S.BOX), F.round(X.tile_resolution(d["z"], d["y"]), 9).alias("resolution"))


# --- assignment

RANK_SQL = "dense_rank() OVER (ORDER BY priority)"
HASH_SQL = "((fid::HUGEINT * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT)"
H1_SQL = f"""{G1_SQL}, h0 AS (SELECT *, {RANK_SQL} AS rank, {HASH_SQL} AS m FROM g1), h1 AS (SELECT *, xor(m, m >> 30) AS h FROM h0)"""


@register(f"WITH {G1_SQL} SELECT fid, CASE WHEN priority IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY priority NULLS FIRST) - (SELECT count(*) > 0 FROM g1 WHERE priority IS NULL)::INT END::BIGINT AS rank FROM g1")
def priority_rank(spark, sf_dir):
    """ASG-04/ASG-05/WIN-01."""
    return A.priority_rank(g1(spark, sf_dir), "priority").select("fid", "rank")


@register(f"WITH {H1_SQL} SELECT fid, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS h FROM h1")
def row_hash(spark, sf_dir):
    """ASG-06."""
    return g1(spark, sf_dir).select("fid", X.row_hash(F.col("fid")).alias("h"))


@register(f"WITH {G1_SQL} SELECT fid, floor(x / 32.0e0)::DOUBLE AS ix, floor(y / 32.0e0)::DOUBLE AS iy FROM g1")
def point_cells(spark, sf_dir):
    """ASG-07."""
    return g1(spark, sf_dir).select("fid", X.cell(F.col("x"), 32.0).alias("ix"), X.cell(F.col("y"), 32.0).alias("iy"))


def thin_sql(ladder) -> str:
    """The loop of ASG-08, unrolled: one winner for each cell that holds no assigned point."""
    out, taken = [f"WITH {H1_SQL}"], []
    for i, r in enumerate(ladder[:-1]):
        pitch = f"{r * 4.0!r}e0"
        union = " UNION ALL ".join(f"SELECT fid, x, y FROM w{j}" for j in taken) if taken else "SELECT fid, x, y FROM h1 WHERE false"
        out.append(f"""t{i} AS ({union}), c{i} AS (SELECT h1.*, floor(x / {pitch}) AS ix, floor(y / {pitch}) AS iy FROM h1 WHERE fid NOT IN (SELECT fid FROM t{i})),
o{i} AS (SELECT DISTINCT floor(x / {pitch}) AS ix, floor(y / {pitch}) AS iy FROM t{i}),
w{i} AS (SELECT fid, x, y FROM (SELECT c.*, row_number() OVER (PARTITION BY c.ix, c.iy ORDER BY rank DESC, h DESC, fid DESC) AS rn FROM c{i} c LEFT JOIN o{i} o ON c.ix = o.ix AND c.iy = o.iy WHERE o.ix IS NULL) z WHERE rn = 1)""")
        taken.append(i)
    won = " UNION ALL ".join(f"SELECT fid, {i} AS level FROM w{i}" for i in taken)
    return ",\n".join(out) + f"\nSELECT h1.fid, coalesce(v.level, {len(ladder) - 1})::INT AS level FROM h1 LEFT JOIN ({won}) v ON h1.fid = v.fid"


@register(thin_sql(LADDER))
def thin_points(spark, sf_dir):
    """ASG-08/WIN-02/JOI-03, nested ladder."""
    return A.thin_points(g1_boxes(spark, sf_dir), LADDER).select("fid", "level")


@register(thin_sql(ODD_LADDER))
def thin_points_general(spark, sf_dir):
    """ASG-08, any ladder."""
    return A.thin_points(g1_boxes(spark, sf_dir), ODD_LADDER).select("fid", "level")


def visible_sql(factor: float, ladder=LADDER) -> str:
    cases = " ".join(f"WHEN w*w + h*h >= {(r * factor) ** 2!r}e0 THEN {i}" for i, r in enumerate(ladder))
    return f"CASE WHEN w*w + h*h <= 0 THEN 0 {cases} ELSE {len(ladder) - 1} END::INT"


@register(f"WITH {G2_SQL}, b AS (SELECT fid, max(x) - min(x) AS w, max(y) - min(y) AS h FROM g2 GROUP BY fid) SELECT fid, {visible_sql(0.25)} AS level FROM b")
def visibility_lines(spark, sf_dir):
    """FLT-12/ASG-09."""
    b = g2(spark, sf_dir).groupBy("fid").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    return b.select("fid", X.visible_level(F.lit(1), [F.col(c) for c in S.BOX], LADDER, 0.25, 4.0).alias("level"))


@register(f"WITH {G3_SQL}, b AS (SELECT fid, xmax - xmin AS w, ymax - ymin AS h FROM g3) SELECT fid, {visible_sql(0.5)} AS level FROM b")
def visibility_polygons(spark, sf_dir):
    """FLT-12/ASG-09."""
    return g3(spark, sf_dir).select("fid", X.visible_level(F.lit(2), [F.col(c) for c in S.BOX], LADDER, 4.0, 0.5).alias("level"))


P_SQL = f"WITH {G3_SQL}, b AS (SELECT fid, xmin, ymin, xmax, ymax, xmax - xmin AS w, ymax - ymin AS h FROM g3), p AS (SELECT *, {visible_sql(0.5)} AS level FROM b)"


def p_levels(spark, sf_dir):
    return g3(spark, sf_dir).withColumn("level", X.visible_level(F.lit(2), [F.col(c) for c in S.BOX], LADDER, 4.0, 0.5))


@register(f"{P_SQL}, n AS (SELECT l.level::INT AS level, count(p.fid) AS n FROM range(0, 5) l(level) LEFT JOIN p ON p.level = l.level GROUP BY 1) SELECT level, n, sum(n) OVER (ORDER BY level)::BIGINT AS cumulative FROM n")
def level_counts(spark, sf_dir):
    """AGG-03/AGG-04/WIN-03."""
    return A.level_counts(p_levels(spark, sf_dir), 5)


@register(f"""{P_SQL}, n AS (SELECT level, count(*) AS n FROM p GROUP BY level), c AS (SELECT level, sum(n) OVER (ORDER BY level) AS c FROM n), r AS (SELECT coalesce(min(level) FILTER (WHERE c >= 2048), 4) AS root FROM c)
SELECT fid, level AS entry_level, greatest(level, root)::INT AS level FROM p, r""")
def fold_root(spark, sf_dir):
    """ASG-11/ASG-15."""
    return A.fold_root(p_levels(spark, sf_dir), 5, 2048).select("fid", "entry_level", "level")


@register(f"{P_SQL} SELECT fid, (dense_rank() OVER (ORDER BY level) - 1)::INT AS level FROM p WHERE level <> 2")
def remap_levels(spark, sf_dir):
    """ASG-12/ASG-13/ASG-14."""
    rows = p_levels(spark, sf_dir).where("level <> 2")
    occupied = sorted(r.level for r in rows.select("level").distinct().collect())
    return A.remap_levels(rows, occupied or [0]).select("fid", "level")


@register(f"WITH {G3_SQL} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM g3")
def dataset_envelope(spark, sf_dir):
    """AGG-01/AGG-06."""
    return S.envelope(g3(spark, sf_dir))


@register(f"{P_SQL} SELECT level, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM p GROUP BY level")
def level_envelope(spark, sf_dir):
    """AGG-02."""
    return S.envelope(p_levels(spark, sf_dir), ["level"])


# --- geometry


@register(f"WITH {G3_SQL}, {G4_SQL} SELECT 'g3' AS source, fid, xmin, ymin, xmax, ymax, 2::INT AS kind, 2::INT AS header_kind FROM g3 UNION ALL SELECT 'g4', fid, x0, y0, CASE WHEN has_second THEN x0 + s * 3 ELSE x0 + s END, y0 + s, 2, 2 FROM g4")
def wkb_bbox_kind(spark, sf_dir):
    """ASG-01/ASG-02/GEO-01."""
    both = g3_wkb(spark, sf_dir).select(F.lit("g3").alias("source"), "fid", "geometry").unionByName(g4_wkb(spark, sf_dir).select(F.lit("g4").alias("source"), "fid", "geometry"))
    return both.withColumn("b", wkb_bbox(F.col("geometry"))).select("source", "fid", *(F.col(f"b.{c}").alias(c) for c in (*S.BOX, "kind")), X.wkb_kind(F.col("geometry")).alias("header_kind"))


@register(f"WITH {G3_SQL} SELECT fid, round((xmax - xmin) * (ymax - ymin), 6) AS area, round(2 * ((xmax - xmin) + (ymax - ymin)), 6) AS perimeter FROM g3")
def geom_metrics(spark, sf_dir):
    """GEO-12, through WKB and back."""
    rings = g3_wkb(spark, sf_dir).select("fid", wkb_geometry(F.col("geometry"))["parts"][0][0].alias("ring"))
    return rings.select("fid", F.round(X.signed_area(F.col("ring")), 6).alias("area"), F.round(X.line_length(F.col("ring")), 6).alias("perimeter"))


@register(f"WITH {G2_SQL}, s AS (SELECT fid, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM g2 WINDOW w AS (PARTITION BY fid ORDER BY ts, event_id)) SELECT fid, count(*) AS n, round(coalesce(sum(sqrt(dx*dx + dy*dy)), 0.0e0), 6) AS length FROM s GROUP BY fid")
def line_metrics(spark, sf_dir):
    """GEO-12 on lines."""
    return g2_lines(spark, sf_dir).select("fid", F.size("line").cast("long").alias("n"), F.round(X.line_length(F.col("line")), 6).alias("length"))


@register(f"WITH {G1_SQL}, q AS (SELECT fid, round((x - 0.5e0) / 0.25e0)::BIGINT AS qx, round((y + 0.25e0) / 0.25e0)::BIGINT AS qy FROM g1) SELECT fid, qx, qy, 0.5e0 + 0.25e0 * qx::DOUBLE AS x, -0.25e0 + 0.25e0 * qy::DOUBLE AS y FROM q")
def quantize(spark, sf_dir):
    """GEO-05/GEO-09/GEO-21."""
    q = g1(spark, sf_dir).select("fid", X.quantize(F.col("x"), 0.25, 0.5).alias("qx"), X.quantize(F.col("y"), 0.25, -0.25).alias("qy"))
    return q.withColumns({"x": X.dequantize(F.col("qx"), 0.25, 0.5), "y": X.dequantize(F.col("qy"), 0.25, -0.25)})


@register(f"""WITH {G1_SQL}, s AS (SELECT fid, x, y, ((x - 10.0e0)*30.0e0 + (y + 5.0e0)*20.0e0) / 1300.0e0 AS t FROM g1), c AS (SELECT fid, x, y, greatest(0.0e0, least(1.0e0, t)) AS t FROM s)
SELECT fid, round((x - (10.0e0 + t*30.0e0))*(x - (10.0e0 + t*30.0e0)) + (y - (-5.0e0 + t*20.0e0))*(y - (-5.0e0 + t*20.0e0)), 6) AS d2 FROM c""")
def segment_distance(spark, sf_dir):
    """GEO-11."""
    d2 = X.segment_distance2(F.col("x"), F.col("y"), X.lit(10), X.lit(-5), X.lit(40), X.lit(15))
    return g1(spark, sf_dir).select("fid", F.round(d2, 6).alias("d2"))


PIXEL_SQL = """p0 AS (SELECT fid, ((x + 180.0e0) / 360.0e0 * 8.0e0 - 3.0e0) * 4096.0e0 AS px, sin(radians(greatest(-85.0511287798066e0, least(85.0511287798066e0, y)))) AS s FROM g1),
p1 AS (SELECT fid, px + floor((2048.0e0 - px) / 32768.0e0 + 0.5e0) * 32768.0e0 AS px, ((0.5e0 - ln((1.0e0 + s) / (1.0e0 - s)) / (4.0e0 * pi())) * 8.0e0 - 2.0e0) * 4096.0e0 AS py FROM p0)"""


@register(f"WITH {G1_SQL}, {PIXEL_SQL} SELECT fid, floor(px + 0.5e0)::BIGINT AS px, floor(py + 0.5e0)::BIGINT AS py FROM p1")
def tile_project(spark, sf_dir):
    """GEO-31."""
    return g1(spark, sf_dir).select("fid", X.tile_pixel(F.col("x"), F.col("y"), 3, 3, 2).alias("p")).select("fid", "p.*")


TILE_SQL = """t0 AS (SELECT *, sin(radians(greatest(-85.0511287798066e0, least(85.0511287798066e0, y)))) AS s FROM g1),
t AS (SELECT *, least(greatest(floor((x + 180.0e0) / 360.0e0 * 8.0e0)::BIGINT, 0), 7)::BIGINT AS tile_x, least(greatest(floor((0.5e0 - ln((1.0e0 + s) / (1.0e0 - s)) / (4.0e0 * pi())) * 8.0e0)::BIGINT, 0), 7)::BIGINT AS tile_y FROM t0)"""


@register(f"WITH {G1_SQL}, {TILE_SQL} SELECT tile_x, tile_y, count(*) AS n FROM t GROUP BY tile_x, tile_y")
def tile_assign_count(spark, sf_dir):
    """GEO-31/SNK-15."""
    return T.assign_tiles(g1(spark, sf_dir), 3).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


@register(f"""WITH {G1_SQL}, i AS (SELECT fid, round(x)::INT AS x, round(y)::INT AS y, event_type FROM g1)
SELECT fid, '{{"type":"Feature","id":' || fid || ',"geometry":{{"type":"Point","coordinates":[' || x || '.0,' || y || '.0]}},"properties":{{"event_type":"' || event_type || '"}}}}' AS feature FROM i""")
def geojson_points(spark, sf_dir):
    """SNK-14/GEO-04."""
    p = g1(spark, sf_dir).withColumns({"x": F.round("x"), "y": F.round("y")})
    plus = lambda c: F.when(F.col(c) == 0, X.lit(0)).otherwise(F.col(c))  # noqa: E731  no negative zero
    parts = F.array(F.array(F.array(F.struct(plus("x").alias("x"), plus("y").alias("y")))))
    return p.select("fid", feature_json(geometry_json(F.lit(1), parts), ["event_type"], "fid").alias("feature"))


@register("SELECT event_id AS fid, event_type AS s, user_id::VARCHAR AS i, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((extract('millisecond' FROM ts)::BIGINT % 1000)::VARCHAR, 3, '0') || 'Z' AS t, CASE WHEN event_id % 2 = 0 THEN '<bytes:' || length(event_type) || '>' ELSE '' END AS b FROM events")
def display_strings(spark, sf_dir):
    """GEO-37."""
    e = source(spark, sf_dir, "events")
    b = F.when(F.col("event_id") % 2 == 0, F.col("event_type").cast("binary"))
    return e.select(F.col("event_id").alias("fid"), display(F.col("event_type"), "string").alias("s"), display(F.col("user_id"), "bigint").alias("i"), display(F.col("ts"), "timestamp").alias("t"), display(b, "binary").alias("b"))


# --- limits


@register(f"WITH {G1_SQL} SELECT fid, x, y FROM g1 WHERE x >= 0 ORDER BY fid LIMIT 100")
def limit_source_order(spark, sf_dir):
    """LIM-01/SRT-02."""
    return M.first_rows(g1(spark, sf_dir).where("x >= 0").select("fid", "x", "y"), 100, "fid")


@register(f"WITH {G1_SQL}, {TILE_SQL} SELECT fid, tile_x, tile_y FROM (SELECT fid, tile_x, tile_y, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY fid) AS rn FROM t) z WHERE rn <= 7")
def limit_per_tile(spark, sf_dir):
    """LIM-04."""
    return M.per_tile(T.assign_tiles(g1(spark, sf_dir), 3).select("fid", "tile_x", "tile_y"), 7, ["tile_x", "tile_y"], "fid")


@register(f"""WITH {G1_SQL}, r AS (SELECT fid, CASE WHEN fid < 100 THEN 0 WHEN fid < 700 THEN 1 ELSE 2 END AS level FROM g1 WHERE fid < 3000 ORDER BY fid LIMIT 1500)
SELECT l.level::INT AS level, count(r.fid) AS n FROM range(0, 3) l(level) LEFT JOIN r ON r.level = l.level GROUP BY 1""")
def read_budget(spark, sf_dir):
    """LIM-03/AGG-04."""
    return M.read_budget(g1(spark, sf_dir).select(F.col("fid").alias("row_index")), (100, 700, 3000, 2**62), 2, 1500)[1]


# --- projections


@register("SELECT event_id AS fid, event_type AS \"a.b\", user_id AS renamed, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events")
def nested_projection(spark, sf_dir):
    """PRJ-01/PRJ-02/PRJ-11."""
    e = source(spark, sf_dir, "events")
    inner = F.when(F.col("event_id") % 5 != 0, F.struct(F.col("value").alias("v")))
    e = e.select(F.col("event_id").alias("fid"), F.struct(F.col("event_type").alias("b"), F.col("user_id").alias("u"), inner.alias("deep")).alias("a"))
    return project(e, {"fid": "fid", "a.b": "a.b", "renamed": "a.u", "v": "a.deep.v"})


@register("SELECT vec_id, embedding[1] AS first, embedding[64] AS last, NULL::FLOAT AS beyond, label AS known, NULL::INT AS missing FROM embeddings")
def map_list_paths(spark, sf_dir):
    """PRJ-01/PRJ-02/PRJ-05."""
    e = source(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.create_map(F.lit("label"), F.col("label")).alias("m"))
    return project(e, {"vec_id": "vec_id", "first": "embedding[0]", "last": "embedding[63]", "beyond": "embedding[999]", "known": "m.label", "missing": "m.other"})


# --- layout statistics

RG_SQL = f"""{G3_SQL}, n AS (SELECT *, (row_number() OVER (ORDER BY fid) - 1) AS rn FROM g3), f AS (SELECT floor(rn / 1000)::BIGINT AS rg, count(*) AS rows, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM n GROUP BY 1)"""
HIT_SQL = f"{RG_SQL}, {BOXES_SQL}, hit AS (SELECT q.q::INT AS q, f.* FROM f JOIN q ON f.xmax >= qx0 AND f.xmin <= qx1 AND f.ymax >= qy0 AND f.ymin <= qy1)"
FINE_SQL = HIT_SQL.replace("rn / 1000", "rn / 50")


def footer_of(spark, sf_dir, size=1000):
    return S.row_group_stats(chunks(g3(spark, sf_dir), size, "fid"))


def boxes(spark):
    return values(spark, BOXES, "q int, qx0 double, qy0 double, qx1 double, qy1 double")


@register(f"WITH {RG_SQL} SELECT rg, rows, xmin, ymin, xmax, ymax, coalesce(sum(rows) OVER (ORDER BY rg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_start FROM f")
def rowgroup_stats(spark, sf_dir):
    """SRC-07/FLT-03/AGG-05/WIN-04/WIN-05."""
    return footer_of(spark, sf_dir)


@register(f"WITH {HIT_SQL} SELECT q.q::INT AS q, count(hit.rg) AS hits, coalesce(sum(rows), 0)::BIGINT AS rows FROM q LEFT JOIN hit ON hit.q = q.q GROUP BY 1")
def rowgroup_selectivity(spark, sf_dir):
    """FLT-02/FLT-04/AGG-09/SET-01."""
    return S.selectivity(S.hits(footer_of(spark, sf_dir), boxes(spark)), boxes(spark))


@register(f"WITH {FINE_SQL}, i AS (SELECT q, rg, rg - row_number() OVER (PARTITION BY q ORDER BY rg) AS island FROM hit), r AS (SELECT q, island, count(*) AS n, min(rg) AS lo, max(rg) AS hi FROM i GROUP BY q, island) SELECT q, sum(n)::BIGINT AS hits, count(*) AS runs, max(n) AS longest, max(hi) - min(lo) + 1 AS span FROM r GROUP BY q")
def contiguity(spark, sf_dir):
    """AGG-10/WIN-07."""
    return S.contiguity(S.hits(footer_of(spark, sf_dir, 50), boxes(spark)))


@register(f"WITH {FINE_SQL}, b AS (SELECT q, rg - lag(rg) OVER (PARTITION BY q ORDER BY rg) - 1 AS gap FROM hit) SELECT q, count(*) FILTER (WHERE gap IS NULL OR gap > 2) AS clusters FROM b GROUP BY q")
def gap_clusters(spark, sf_dir):
    """AGG-11."""
    return S.gap_clusters(S.hits(footer_of(spark, sf_dir, 50), boxes(spark)), 2)


@register(f"WITH {G3_SQL}, v AS (SELECT list_sort(list((xmax - xmin) * (ymax - ymin))) AS a FROM g3) SELECT a[floor(0.95e0 * (len(a) - 1))::BIGINT + 1] AS p95, a[floor(0.5e0 * (len(a) - 1))::BIGINT + 1] AS p50 FROM v")
def p95_lower(spark, sf_dir):
    """AGG-07."""
    v = g3(spark, sf_dir).select(((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("a"))
    return S.lower_percentiles(v, {"p95": ("a", 0.95), "p50": ("a", 0.5)})


@register(f"""WITH {RG_SQL}, s AS (SELECT (xmax - xmin) * (ymax - ymin) AS area, greatest((xmax - xmin) / (ymax - ymin), (ymax - ymin) / (xmax - xmin)) AS aspect FROM f), l AS (SELECT sum(area) AS area_sum, list_sort(list(area)) AS a, list_sort(list(aspect)) AS b FROM s)
SELECT round(area_sum, 6) AS area_sum, a[floor(0.5e0 * (len(a) - 1))::BIGINT + 1] AS area_median, a[floor(0.95e0 * (len(a) - 1))::BIGINT + 1] AS area_p95, b[floor(0.5e0 * (len(b) - 1))::BIGINT + 1] AS aspect_median, b[floor(0.95e0 * (len(b) - 1))::BIGINT + 1] AS aspect_p95, b[len(b)] AS aspect_max FROM l""")
def rowgroup_shape(spark, sf_dir):
    """AGG-08."""
    return S.shape_stats(footer_of(spark, sf_dir)).withColumn("area_sum", F.round("area_sum", 6))


def byte_ranges(spark, sf_dir) -> DataFrame:
    return source(spark, sf_dir, "orders").selectExpr("o_custkey % 7 AS k", "(o_orderkey * 977) % 1000000 AS start", "(o_orderkey * 977) % 1000000 + 40 + o_custkey % 90 AS stop")


RANGE_SQL = "r AS (SELECT o_custkey % 7 AS k, (o_orderkey * 977) % 1000000 AS start, (o_orderkey * 977) % 1000000 + 40 + o_custkey % 90 AS stop FROM orders)"


@register(f"""WITH {RANGE_SQL}, m AS (SELECT *, max(stop) OVER (PARTITION BY k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 64 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT k, min(start) AS start, max(stop) AS stop, count(*) AS n FROM g GROUP BY k, part""")
def range_merge(spark, sf_dir):
    """IO-01/SET-02."""
    return S.merge_ranges(byte_ranges(spark, sf_dir), 64, ["k"])


PAGE_SQL = f"{G3_SQL}, p AS (SELECT *, floor((row_number() OVER (ORDER BY fid) - 1) / 1000)::BIGINT AS rg, ((row_number() OVER (ORDER BY fid) - 1) % 1000)::BIGINT AS row FROM g3)"


def paged(spark, sf_dir) -> DataFrame:
    """Rectangles with their row group of a thousand and their row in it."""
    rows = global_rank(g3(spark, sf_dir), [F.asc("fid")], "at")
    return rows.withColumns({"rg": F.floor(F.col("at") / 1000), "row": F.col("at") % 1000})


@register(f"""WITH {PAGE_SQL}, a AS (SELECT rg, row // 100 AS page, min(row) AS f, max(row) AS l FROM p GROUP BY 1, 2), b AS (SELECT rg, row // 130 AS page, min(row) AS f, max(row) AS l FROM p GROUP BY 1, 2)
SELECT a.rg, a.page AS covering_page, b.page AS other_page FROM a JOIN b ON a.rg = b.rg AND a.f <= b.l AND a.l >= b.f""")
def page_overlap(spark, sf_dir):
    """JOI-08/INS-02: pages of 100 rows of one column against pages of 130 of another."""
    rows = paged(spark, sf_dir).select("rg", "row")
    return P.page_overlap(P.pages_of(rows, 100), P.pages_of(rows, 130))


@register(f"""WITH {PAGE_SQL}, k AS (SELECT rg, row, row - row_number() OVER (PARTITION BY rg ORDER BY row) AS island FROM p WHERE xmax >= -90 AND xmin <= 120)
SELECT rg, min(row) AS start, max(row) + 1 AS stop FROM k GROUP BY rg, island""")
def selection_ranges(spark, sf_dir):
    """FLT-06: runs of selected rows in each row group."""
    return P.selection_ranges(paged(spark, sf_dir).select("rg", "row", ((F.col("xmax") >= -90) & (F.col("xmin") <= 120)).alias("kept")))


@register(f"""WITH RECURSIVE {RANGE_SQL}, d AS (SELECT DISTINCT k, start, stop FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY start, stop) AS i FROM d),
s AS (SELECT k, i, start AS b, stop AS e, 0::BIGINT AS waste FROM o WHERE i = 1 UNION ALL
  SELECT o.k, o.i, CASE WHEN j THEN b ELSE start END, CASE WHEN j THEN greatest(e, stop) ELSE stop END, CASE WHEN j THEN waste + greatest(0, start - e) ELSE 0 END
  FROM (SELECT o.*, s.b, s.e, s.waste, greatest(0, o.start - s.e) <= 64 AND s.waste + greatest(0, o.start - s.e) <= 200 AND greatest(s.e, o.stop) - s.b <= 2000 AS j FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1) o)
SELECT k, b AS start, max(e)::BIGINT AS stop, count(*) AS n FROM s GROUP BY k, b""")
def range_budgets(spark, sf_dir):
    """IO-01: requests by gap, extra bytes and size."""
    return P.coalesce_ranges(byte_ranges(spark, sf_dir).distinct(), 64, 200, 2000, "k")


@register(f"""WITH {RANGE_SQL}, m AS (SELECT *, max(stop) OVER (PARTITION BY k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 64 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT DISTINCT k, start, stop, request, start - request AS "offset" FROM (SELECT *, min(start) OVER (PARTITION BY k, part) AS request FROM g) x""")
def range_slices(spark, sf_dir):
    """IO-02: where each range lies in the merged one."""
    r = byte_ranges(spark, sf_dir).distinct()
    return P.slices_of(r, S.merge_ranges(r, 64, ["k"]), "k")


@register(f"WITH {RG_SQL.replace('rn / 1000', 'rn / 100')} SELECT rg, rows, xmin, ymin, xmax, ymax FROM f WHERE {IN_BOX}")
def page_prune(spark, sf_dir):
    """FLT-05/FLT-08."""
    return S.pages_kept(footer_of(spark, sf_dir, 100), BOX).drop("row_start")


@register(f"""WITH {G3_SQL}, n AS (SELECT *, floor((row_number() OVER (ORDER BY fid) - 1) / 1000)::BIGINT AS rg FROM g3), c AS (SELECT rg, count(*) AS rows, count(*) FILTER (WHERE rg > 3 OR fid % 4001 = 0) AS a, count(*) FILTER (WHERE rg > 7) AS b FROM n GROUP BY rg),
u AS (SELECT rg, 'l0' AS lod, rows, a AS nulls, 3 AS e FROM c UNION ALL SELECT rg, 'l1', rows, b, 7 FROM c) SELECT rg, lod, rows, nulls FROM u WHERE CASE WHEN rg <= e THEN nulls > 0 ELSE nulls < rows END""")
def coverage_check(spark, sf_dir):
    """VAL-10/AGG-15."""
    rows = chunks(g3(spark, sf_dir), 1000, "fid")
    l0, l1 = F.when((F.col("rg") <= 3) & (F.col("fid") % 4001 != 0), 1), F.when(F.col("rg") <= 7, 1)
    bounds = values(spark, [("l0", 3), ("l1", 7)], "lod string, row_group_end int")
    return S.coverage_errors(S.coverage(rows.select("rg", l0.alias("l0"), l1.alias("l1")), ["l0", "l1"]), bounds)


FILES = (("good", 0, 1, 100.0, 4), ("good", 1, 3, 10.0, 4), ("order", 0, 2, 100.0, 4), ("order", 1, 1, 10.0, 4), ("short", 0, 1, 5.0, 4), ("res", 0, 3, 10.0, 4), ("res", 1, 3, 10.0, 4), ("neg", 0, 0, -1.0, 1))


@register(f"""WITH v(file, level, e, r, n) AS (VALUES {', '.join(f"('{a}', {b}, {c}, {d!r}e0, {e})" for a, b, c, d, e in FILES)}),
w AS (SELECT *, lag(e) OVER (PARTITION BY file ORDER BY level) AS pe, lag(r) OVER (PARTITION BY file ORDER BY level) AS pr, lead(level) OVER (PARTITION BY file ORDER BY level) IS NULL AS last FROM v)
SELECT file, level::INT AS level, problem FROM (
SELECT file, level, 'row_group_end out of range' AS problem FROM w WHERE e < 0 OR e >= n UNION ALL SELECT file, level, 'row_group_end decreases' FROM w WHERE e < pe UNION ALL
SELECT file, level, 'last level does not reach the last row group' FROM w WHERE last AND e <> n - 1 UNION ALL SELECT file, level, 'resolution not positive and finite' FROM w WHERE r <= 0 UNION ALL
SELECT file, level, 'resolution does not decrease' FROM w WHERE r >= pr) z""")
def level_meta_check(spark, sf_dir):
    """VAL-01."""
    return L.check_levels(values(spark, FILES, "file string, level int, row_group_end int, resolution double, n_row_groups int"))


@register("SELECT * FROM (VALUES ('b', 1::INT, 2::INT), ('b', 2::INT, 0::INT), ('c', 7::INT, 1::INT)) t(file, level, n_lods)")
def lod_meta_check(spark, sf_dir):
    """VAL-02/JOI-07."""
    levels = values(spark, [(f, i) for f in "abc" for i in range(3)], "file string, level int")
    lods = spark.createDataFrame([("a", [0]), ("a", [1, 2]), ("b", [0, 1]), ("b", [1]), ("c", [0, 1, 2, 7])], "file string, level_indices array<int>")
    return L.check_lods(levels, lods).withColumn("n_lods", F.col("n_lods").cast("int"))


@register(f"""WITH {G1_SQL}, {G3_SQL}
SELECT g1.fid AS l_fid, g3.fid AS r_fid FROM g1 JOIN g3 ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax""")
def bbox_spatial_join(spark, sf_dir):
    """JOI-06: all points against all rectangles."""
    p = g1(spark, sf_dir).select("fid", F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    return bbox_join(p, g3(spark, sf_dir), 4.0).select("l_fid", "r_fid")


@register(f"""WITH {G3_SQL}
SELECT a.fid AS l_fid, b.fid AS r_fid FROM g3 a JOIN g3 b ON a.xmax >= b.xmin AND a.xmin <= b.xmax AND a.ymax >= b.ymin AND a.ymin <= b.ymax AND a.fid < b.fid""")
def bbox_self_join(spark, sf_dir):
    """JOI-06: all rectangles against all others, each pair once."""
    r = g3(spark, sf_dir)
    return bbox_join(r, r, 4.0).where("l_fid < r_fid").select("l_fid", "r_fid")


# --- whole plans


def geo(kind: str) -> dict:
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": [kind]}}}


def converted(spark, rows: DataFrame, kind: str, o: Options) -> str:
    """A file, or a folder of them, in the folder that driver and executors share."""
    path = shared_path(spark, "layout") + ("" if o.files else ".parquet")
    convert(rows, path, geo(kind), o).count()
    return path


def taken(df: DataFrame, path: str) -> DataFrame:
    """The rows of a query over a converted file, which then goes."""
    out = written(df, "result")
    deleted(df.sparkSession, path)
    return out


def g1_wkb(spark, sf_dir) -> DataFrame:
    return g1(spark, sf_dir).withColumn("geometry", to_wkb(F.lit(1), F.array(F.array(F.array(F.struct("x", "y"))))))


@register(f"WITH {G1_SQL} SELECT fid AS id, x, y, event_type FROM g1")
def convert_roundtrip(spark, sf_dir):
    """SNK-01..SNK-12, SRC-01..SRC-11: points through a file and back, nothing lost."""
    p = g1_wkb(spark, sf_dir).select("fid", F.col("fid").alias("id"), "event_type", "priority", "geometry")
    path = converted(spark, p, "Point", Options(LADDER, row_group_size=1000, page_rows=100, min_root_features=64, priority="priority"))
    t = LodTable.open(spark, path)
    at = F.col("geometry.parts")[0][0][0]
    return taken(t.read(columns=["id", "event_type"]).select("id", at["x"].alias("x"), at["y"].alias("y"), "event_type"), path)


@register(f"{thin_sql(LADDER).replace('SELECT h1.fid,', 'SELECT h1.fid, h1.x, h1.y,')}".replace("WITH ", "WITH z AS (WITH ", 1) + f") SELECT fid AS id, x, y FROM z WHERE level <= 2 AND x BETWEEN {BOX[0]}e0 AND {BOX[2]}e0 AND y BETWEEN {BOX[1]}e0 AND {BOX[3]}e0")
def viewport_read(spark, sf_dir):
    """The flagship: thin, pack, write, then read a viewport at a resolution. SRC-11/LVL-01/FLT-09/LIM-01."""
    p = g1_wkb(spark, sf_dir).select("fid", F.col("fid").alias("id"), "x", "y", "priority", "geometry")
    path = converted(spark, p, "Point", Options(LADDER, row_group_size=200, page_rows=50, min_root_features=1, priority="priority"))
    t = LodTable.open(spark, path)
    return taken(t.read(t.select_level(2.0), BOX, ["id", "x", "y"], geometry=False).drop("row_index"), path)


@register(f"WITH {G3_SQL} SELECT fid AS id FROM g3 WHERE {IN_BOX}")
def file_bbox_scan(spark, sf_dir):
    """SRC-08/SRC-09/SNK-12/FLT-02: rectangles through a file, then Spark's own scan with a pushed-down box."""
    path = converted(spark, g3_wkb(spark, sf_dir).select("fid", F.col("fid").alias("id"), "geometry"), "Polygon", Options(LADDER, row_group_size=1000, page_rows=100, min_root_features=1, overviews=False))
    t = LodTable.open(spark, path)
    return taken(t.scan().where(X.bbox_intersects(*(F.col(f"bbox.{c}") for c in S.BOX), BOX)).select("id"), path)


FILES_OPTIONS = Options(LADDER, row_group_size=300, page_rows=50, min_root_features=1, priority="priority", files=4)


@register(f"{thin_sql(LADDER).replace('SELECT h1.fid,', 'SELECT h1.fid, h1.x, h1.y,')}".replace("WITH ", "WITH z AS (WITH ", 1) + f") SELECT fid AS id, x, y FROM z WHERE level <= 3 AND x BETWEEN {BOX[0]}e0 AND {BOX[2]}e0 AND y BETWEEN {BOX[1]}e0 AND {BOX[3]}e0")
def multi_file_read(spark, sf_dir):
    """SRC-09/SRC-11/LVL-05: a layout of several files, of which a viewport reads each one's level prefix."""
    p = g1_wkb(spark, sf_dir).select("fid", F.col("fid").alias("id"), "x", "y", "priority", "geometry")
    path = converted(spark, p, "Point", FILES_OPTIONS)
    t = LodFolder.open(spark, path)
    return taken(t.read(t.select_level(1.0), BOX, ["id", "x", "y"], geometry=False).drop("row_index"), path)


@register(f"WITH {G1_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY fid) - 1 AS row_index, count(*) OVER () AS n FROM g1) SELECT row_index, fid AS id, event_type FROM n WHERE row_index IN (0, n // 3, n - 1)")
def point_lookup(spark, sf_dir):
    """SRC-12: single rows by their absolute index, of a file whose only node keeps the source order."""
    p = g1_wkb(spark, sf_dir).select("fid", F.col("fid").alias("id"), "event_type", "geometry")
    path = converted(spark, p, "Point", Options((1.0,), row_group_size=10_000_000, page_rows=10_000_000))
    t = LodTable.open(spark, path)
    n = t.md.num_rows
    rows = [t.read_row(i, ["id", "event_type"]) for i in sorted({0, n // 3, n - 1})]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return taken(out, path)


@register(f"WITH {G1_SQL} SELECT fid, x, y, event_type, 'geoarrow.multipoint' AS kind FROM g1")
def geoarrow(spark, sf_dir):
    """SNK-16/SNK-17/GEO-35/GEO-36: points as GeoArrow streams and back."""
    rows = g1_wkb(spark, sf_dir).select("fid", "event_type", "geometry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                table = to_table([parse(w) for w in b.column(2).to_pylist()], pa.table({"event_type": b.column(1)}), b.column(0).to_pylist(), "fid")
                back = pa.ipc.open_stream(to_ipc(table)).read_all()
                xy = pa.compute.list_flatten(back.column("geometry").combine_chunks(), recursive=True).to_numpy().reshape(len(back), -1)
                kind = back.schema.field("geometry").metadata[b"ARROW:extension:name"].decode()
                yield pa.record_batch([back.column("fid").combine_chunks(), pa.array(xy[:, 0]), pa.array(xy[:, 1]), back.column("event_type").combine_chunks(), pa.array([kind] * len(back))], names=["fid", "x", "y", "event_type", "kind"])

    return rows.mapInArrow(run, "fid long, x double, y double, event_type string, kind string")


@register("""WITH r AS (SELECT o_orderkey AS fid, 10 + o_orderkey % 17 AS s, o_custkey % 23 AS dx, o_orderkey % 13 AS dy, 5 + o_custkey % 11 AS t FROM orders),
i AS (SELECT *, greatest(0, least(s, dx + t) - dx) * greatest(0, least(s, dy + t) - dy) AS shared FROM r)
SELECT fid, (s * s + t * t - shared)::DOUBLE AS union_area, (s * s - shared)::DOUBLE AS difference_area FROM i""")
def overlay_area(spark, sf_dir):
    """GEO-26/SET-03: areas of the union of two squares, and of one with the other as a hole."""
    o = source(spark, sf_dir, "orders").selectExpr("o_orderkey AS fid", "10 + o_orderkey % 17 AS s", "o_custkey % 23 AS dx", "o_orderkey % 13 AS dy", "5 + o_custkey % 11 AS t")
    shape = ["s", "dx", "dy", "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
        area = lambda made: sum(abs(topology.area2(p[0])) - sum(abs(topology.area2(h)) for h in p[1:]) for p in made) / 2
        for b in batches:
            pairs = [(square(0, 0, s), square(x, y, t)) for s, x, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.record_batch([*b.columns, pa.array([area(topology.normalize([[p], [q]])) for p, q in pairs], pa.float64()), pa.array([area(topology.normalize([[p, q]])) for p, q in pairs], pa.float64())], names=[*shape, "union_area", "difference_area"])

    # equal pairs of squares are overlaid once
    areas = spread(o.select(*shape).distinct(), *shape).mapInArrow(run, "s long, dx long, dy long, t long, union_area double, difference_area double")
    return sort_joined(o, areas, shape).select("fid", "union_area", "difference_area")


@register(f"{thin_sql(LADDER)}".replace("WITH ", "WITH z AS (WITH ", 1) + ") SELECT level, count(*) AS rows FROM z GROUP BY level")
def file_levels(spark, sf_dir):
    """LVL-09/AGG-04/SRC-16: rows of a converted file by the level that their place in it tells."""
    p = g1_wkb(spark, sf_dir).select("fid", F.col("fid").alias("id"), "priority", "geometry")
    path = converted(spark, p, "Point", Options(LADDER, row_group_size=500, page_rows=100, min_root_features=1, priority="priority"))
    t = LodTable.open(spark, path)
    return taken(t.row_levels(t.read(columns=["id"], geometry=False)).groupBy("level").agg(F.count("*").alias("rows")), path)


def overview_summary(rows: DataFrame, resolution: float) -> DataFrame:
    parts = overview_parts(F.col("geometry"), Grid.of(resolution))
    out = rows.select("fid", parts.alias("p"))
    n = lambda c: F.aggregate(c, F.lit(0), lambda s, p: s + F.aggregate(p, F.lit(0), lambda t, r: t + F.size(r)))
    return out.select("fid", F.coalesce(F.size("p"), F.lit(0)).alias("n_parts"), F.coalesce(n(F.col("p")), F.lit(0)).alias("n_points"))


@register()
def overview_lines(spark, sf_dir):
    """GEO-09..GEO-21 on lines."""
    lines = g2_lines(spark, sf_dir).withColumn("geometry", to_wkb(F.lit(2), F.array(F.array("line"))))
    return overview_summary(lines, 0.25)


@register()
def overview_polygons(spark, sf_dir):
    """GEO-13..GEO-28 on multipolygons with holes."""
    return overview_summary(g4_wkb(spark, sf_dir, True), 1.0)


@register("SELECT 0::BIGINT AS errors, 0::BIGINT AS warnings, true AS overviews_validated")
def validate_overviews(spark, sf_dir):
    """VAL-01..VAL-13, SNK-13: multipolygons with overviews convert to a valid file."""
    path = converted(spark, g4_wkb(spark, sf_dir).select("fid", F.col("fid").alias("id"), "geometry"), "MultiPolygon", Options(LADDER, row_group_size=500, page_rows=100, min_root_features=64))
    r = check(spark, path)
    deleted(spark, path)
    return values(spark, [(len(r.errors), len(r.warnings), r.overviews_validated)], "errors long, warnings long, overviews_validated boolean")


@register(f"""WITH {G2_SQL}, b AS (SELECT fid, max(x) - min(x) AS w, max(y) - min(y) AS h, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM g2 GROUP BY fid), v AS (SELECT *, {visible_sql(1.0, FINE)} AS level FROM b)
SELECT fid AS id, 5::TINYINT AS type, true AS near FROM v WHERE level <= 2""")
def overview_read(spark, sf_dir):
    """SRC-11/GEO-05/PRJ-07/LVL-14 with useOverview: the rows of a level prefix with that level's dequantized
    renderings, whose boxes lie within a cell and the tolerance of the lines' own."""
    lines = g2_lines(spark, sf_dir)
    rows = lines.select("fid", F.col("fid").alias("id"), to_wkb(F.lit(2), F.array(F.array("line"))).alias("geometry"))
    path = converted(spark, rows, "LineString", Options(FINE, row_group_size=50, page_rows=10, min_root_features=1, line_factor=1.0))
    t = LodTable.open(spark, path)
    df = t.read(t.select_level(FINE[2]), None, ["id"], use_overview=True)
    ends = lambda p, c, f: f(F.transform(p, lambda q: q[c]))
    shown = df.select("id", "geometry.type", F.flatten(F.flatten("geometry.parts")).alias("p"))
    both = shown.join(lines.select(F.col("fid").alias("id"), "line"), "id")
    close = [F.abs(ends(F.col("p"), c, f) - ends(F.col("line"), c, f)) <= FINE[2] for c in "xy" for f in (F.array_min, F.array_max)]
    return taken(both.select("id", "type", (close[0] & close[1] & close[2] & close[3]).alias("near")), path)


@register()
def mvt_tiles(spark, sf_dir):
    """SNK-15/GEO-29..GEO-34: tiles of zoom 2 with all their points, and their size."""
    p = T.assign_tiles(g1(spark, sf_dir), 2).withColumnRenamed("fid", "row_index")
    g = F.struct(F.lit(1).cast("tinyint").alias("type"), F.array(F.array(F.array(F.struct("x", "y")))).alias("parts"))
    return T.render_tiles(p.withColumn("geometry", g), 2, ["event_type"], "events").select("z", "tile_x", "tile_y", F.length("tile").alias("bytes"), F.md5("tile").alias("md5"))


@register(f"""WITH {G1_SQL}, {TILE_SQL} SELECT tile_x, tile_y, fid, event_type, floor(((x + 180.0e0) / 360.0e0 * 8.0e0 - tile_x) * 4096.0e0 + 0.5e0)::BIGINT AS px,
  floor(((0.5e0 - ln((1.0e0 + s) / (1.0e0 - s)) / (4.0e0 * pi())) * 8.0e0 - tile_y) * 4096.0e0 + 0.5e0)::BIGINT AS py FROM t""")
def mvt_features(spark, sf_dir):
    """SNK-15/GEO-31..GEO-34/AGG-13: what tiles of zoom 3 hold once they are read again."""
    p = T.assign_tiles(g1(spark, sf_dir), 3).withColumnRenamed("fid", "row_index")
    g = F.struct(F.lit(1).cast("tinyint").alias("type"), F.array(F.array(F.array(F.struct("x", "y")))).alias("parts"))
    tiles = T.render_tiles(p.withColumn("geometry", g), 3, ["event_type"], "events").select("tile_x", "tile_y", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = lambda n: (n >> 1) ^ -(n & 1)
        for b in batches:
            for x, y, tile in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one = decode(tile)["events"]
                rows = [(x, y, f["id"], one["values"][f["tags"][1]], back(f["geometry"][1]), back(f["geometry"][2])) for f in one["features"]]
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["tile_x", "tile_y", "fid", "event_type", "px", "py"])

    return tiles.mapInArrow(run, "tile_x long, tile_y long, fid long, event_type string, px long, py long")


@register(f"""WITH {G3_SQL}, e AS (SELECT max(xmax) - min(xmin) >= max(ymax) - min(ymin) AS wide FROM g3)
SELECT fid, row_number() OVER (ORDER BY CASE WHEN wide THEN (xmin + xmax) / 2 ELSE -((ymin + ymax) / 2) END, fid) - 1 AS pos FROM g3, e""")
def str_order(spark, sf_dir):
    """ASG-16/ASG-18/SRT-01: the order of a node that is split once: along its wider axis, by centers, then by row."""
    rows = g3(spark, sf_dir).withColumn("level", F.lit(0))
    half = max(1, -(-rows.count() // 2))
    return pack(rows, half).select("fid", "pos")


@register(f"WITH {G3_SQL}, n AS (SELECT count(*) AS n FROM g3) SELECT floor(i)::BIGINT AS rg, CASE WHEN (i + 1) * 1000 <= n THEN 1000 ELSE n - i * 1000 END::BIGINT AS rows FROM n, range(0, 1000) t(i) WHERE i * 1000 < n")
def str_pack(spark, sf_dir):
    """ASG-16..ASG-18/SRT-01: every row once, full leaves but the last."""
    rows = g3(spark, sf_dir).withColumn("level", F.lit(0))
    at = pack(rows, 1000, 100)
    return at.select(F.floor(F.col("pos") / 1000).alias("rg")).groupBy("rg").agg(F.count("*").alias("rows"))


@register(f"WITH {G3_SQL} SELECT count(*) AS n, count(DISTINCT fid) AS ids, max(fid) AS top FROM g3")
def pack_keeps_rows(spark, sf_dir):
    """ASG-16: packing is a permutation."""
    at = pack(g3(spark, sf_dir).withColumn("level", (F.col("fid") % 3).cast("int")), 500)
    return at.agg(F.count("*").alias("n"), F.count_distinct("level", "pos").alias("ids"), F.max("fid").alias("top"))


