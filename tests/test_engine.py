import json
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import expr as X
from lodestrata.functions.mvt import decode
from lodestrata.functions.register import register
from lodestrata.functions.wkb import Geometry, write
from lodestrata.operators import assign as A
from lodestrata.operators import stats as S
from lodestrata.operators.limits import first_rows, per_tile, read_budget
from lodestrata.operators.pack import pack, str_order
from lodestrata.operators.project import PathError, project
from lodestrata.operators.spatial_join import bbox_join
from lodestrata.plans import queries
from lodestrata.plans.convert import Options, convert, convert_file
from lodestrata.plans.report import layout_report, markdown
from lodestrata.plans.tiles import parse_tile_url, render_tile, tile_url
from lodestrata.plans.validate import check
from lodestrata.sources.datasource import plain, pruned, read_row_groups
from lodestrata.sources.meta import MetaError
from lodestrata.sources.reader import LodFolder, LodTable
from lodestrata.streaming.convert_stream import convert_stream


def points(spark, rows):
    df = spark.createDataFrame([(i, float(x), float(y), r) for i, (x, y, r) in enumerate(rows)], "fid long, x double, y double, rank long")
    return df.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y"), "kind": F.lit(0)})


def levels(df):
    return [r.level for r in df.orderBy("fid").collect()]


def hashed(row):
    h = row * 0x9E3779B97F4A7C15 % 2**64
    return h ^ (h >> 30)


def thinned(rows, ladder, factor):
    """Level by level: the best point that is left of each cell without a point."""
    level = {}
    for k, r in enumerate(ladder[:-1]):
        cell = lambda i, pitch=r * factor: (math.floor(rows[i][0] / pitch), math.floor(rows[i][1] / pitch))
        full, best = {cell(i) for i in level}, {}
        for i in range(len(rows)):
            if i not in level and cell(i) not in full:
                best[cell(i)] = max(best.get(cell(i), -1), i, key=lambda i: (rows[i][2], hashed(i), i) if i >= 0 else (-1,))
        level |= dict.fromkeys(best.values(), k)
    return [level.get(i, len(ladder) - 1) for i in range(len(rows))]


@pytest.mark.parametrize("ladder", [[32.0, 8.0, 4.0, 0.5], [90.0, 31.0, 7.0, 2.0], [5.0]])
@pytest.mark.parametrize("seed", [1, 2])
def test_thinning_equals_brute_force(spark, ladder, seed):
    rng = random.Random(seed)
    rows = [(rng.uniform(-150, 150), rng.uniform(-150, 150), rng.randrange(6)) for _ in range(180)]
    want = thinned(rows, ladder, 1.5)
    assert levels(A.thin_points(points(spark, rows), ladder, 1.5)) == want
    assert levels(A.thin_points(points(spark, rows).repartition(5), ladder, 1.5, force_general=True)) == want


def test_visibility(spark):
    rng = random.Random(6)
    boxes = [(x, y, x + rng.choice([0, 0.3, 2, 30]), y + rng.choice([0, 0.2, 1, 9])) for x, y in ((rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(60))]
    df = spark.createDataFrame([*((i, *b) for i, b in enumerate(boxes)), (60, None, None, None, None)], "fid long, xmin double, ymin double, xmax double, ymax double")
    ladder, factor = [7.0, 0.9, 0.06], 3.0
    got = df.select("fid", X.visible_level(F.lit(2), [F.col(c) for c in A.BOX], ladder, 4.0, factor).alias("level"))
    size = [(b[2] - b[0]) ** 2 + (b[3] - b[1]) ** 2 for b in boxes]
    want = [next((k for k, r in enumerate(ladder) if d >= (factor * r) ** 2), 2) if d > 0 else 0 for d in size]
    assert levels(got)[:60] == want


def test_ranks(spark):
    values = [7, 3, None, 7, 12, -4, 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "fid long, v int")
    rank = lambda d: [r["rank"] for r in A.priority_rank(df, "v", d).orderBy("fid").collect()]
    for down in (True, False):
        order = sorted({v for v in values if v is not None}, reverse=not down)
        assert rank(down) == [0 if v is None else order.index(v) + 1 for v in values]
    with pytest.raises(ValueError):
        A.priority_rank(df.withColumn("v", F.struct("v")), "v")


@pytest.mark.parametrize("rows, n, least", [([3, 1, 1, 5, 3, 3], 6, 3), ([0, 4], 5, 100), ([2, 2], 3, 2), ([1, 0, 2], 3, 1)])
def test_folding(spark, rows, n, least):
    got = levels(A.fold_root(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "fid long, level int"), n, least))
    root = next((k for k in range(n) if sum(x <= k for x in rows) >= least), n - 1)
    assert got == [max(x, root) for x in rows]


def test_packing():
    rng = np.random.default_rng(1)
    box = np.repeat(rng.random((53, 2)), 2, axis=0).reshape(53, 4)
    assert sorted(str_order(box, np.arange(53), 8, False, True)) == list(range(53))
    assert list(str_order(box[:7], np.arange(7), 8, False, True)) == list(range(7))


def test_percentiles_are_elements(spark):
    rng = random.Random(3)
    values = [rng.choice([None, rng.random(), 0.5]) for _ in range(101)]
    some = sorted(v for v in values if v is not None)
    out = S.lower_percentiles(spark.createDataFrame([(v, 1.0) for v in values], "v double, w double"), {"a": ("v", 0.5), "b": ("v", 0.95), "c": ("w", 1.0)}).first()
    assert tuple(out) == (some[int(0.5 * (len(some) - 1))], some[int(0.95 * (len(some) - 1))], 1.0)
    assert S.lower_percentiles(spark.createDataFrame([], "v double"), {"a": ("v", 0.5)}).first().a is None


def test_packing_distributed_equals_local(spark):
    df = spark.range(500).select(F.col("id").alias("fid"), (F.col("id") * 7919 % 997).cast("double").alias("xmin"), (F.col("id") * 104729 % 991).cast("double").alias("ymin"), F.lit(0).alias("level"))
    df = df.withColumns({"xmax": F.col("xmin"), "ymax": F.col("ymin")})
    order = lambda **k: [r.fid for r in pack(df, 20, **k).orderBy("pos").collect()]
    assert order() == order(local_rows=100)


def test_packing_does_not_depend_on_the_share_of_a_task(spark):
    """FINDINGS_r03 F3, F5: nodes that were split by passes and fit a row group came back in the order of fid."""
    rng = random.Random(8)
    bound = lambda: rng.choice([None, float("nan"), float("inf"), -0.0, 0.0, *(rng.uniform(-9, 9) for _ in range(60))])
    rows = [(i, i % 2, bound(), bound(), bound(), bound()) for i in range(701)]
    df = spark.createDataFrame(rows, "fid long, level int, xmin double, ymin double, xmax double, ymax double").repartition(5)
    order = lambda m, pages, **k: [(r.level, r.fid) for r in pack(df, m, pages, **k).orderBy("level", "pos").collect()]
    for m, pages in ((176, None), (120, 7), (1000, None), (1000, 30)):
        want = order(m, pages)
        assert len(set(want)) == 701
        assert order(m, pages, local_rows=50) == want
    simple = spark.range(101).selectExpr("id AS fid", "0 AS level", "(id * 37 % 101) * 1.0D AS xmin", "0D AS ymin", "(id * 37 % 101) * 1.0D AS xmax", "0D AS ymax")
    got = [r.xmin for r in pack(simple, 51, local_rows=20).orderBy("pos").collect()]
    assert got == sorted(got)


def test_projection(spark):
    df = spark.sql("SELECT named_struct('b', 1, 'c', array(1, 2)) AS a, map('k', 3) AS m, 4 AS `x.y`")
    assert tuple(project(df, ["a.b", "a.c[1]", "a.c[9]", "m.k", "m.z", "x.y"]).first()) == (1, 2, None, 3, None, 4)
    for bad in ("q", "a.z", "a.b.c", "a[0]", "a.c[x]", "a..b"):
        with pytest.raises(PathError):
            project(df, [bad])


def test_limits(spark):
    df = spark.range(100).select(F.col("id").alias("row_index"), (F.col("id") % 3).alias("t"))
    assert [r.row_index for r in first_rows(df, 3).collect()] == [0, 1, 2] and first_rows(df, 0).count() == 0
    assert per_tile(df, 2, ["t"]).count() == 6
    assert [r.n for r in read_budget(df, [10, 50, 100], 1, 30)[1].orderBy("level").collect()] == [10, 20]
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            first_rows(df, bad)


def test_spatial_join(spark):
    a = spark.range(60).select("id", *((F.hash("id", F.lit(k)) % 50).cast("double").alias(c) for k, c in enumerate(("xmin", "ymin"))))
    a = a.withColumns({"xmax": F.col("xmin") + F.col("id") % 7, "ymax": F.col("ymin") + F.col("id") % 5})
    got = {(r.l_id, r.r_id) for r in bbox_join(a, a, 3.0).collect()}
    rows = a.collect()
    assert got == {(p.id, q.id) for p in rows for q in rows if p.xmax >= q.xmin and p.xmin <= q.xmax and p.ymax >= q.ymin and p.ymin <= q.ymax}


def box(x, y, s):
    return write(Geometry(3, [[np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)]]))


def geo(*kinds, **column):
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": list(kinds), **column}}}


def grid_file(tmp_path, n=40):
    rows = [(i, f"n{i}", box(i % 10, i // 10, 0.05 if i % 3 == 0 else 0.5)) for i in range(n)]
    t = pa.table({"id": [r[0] for r in rows], "name": [r[1] for r in rows], "geometry": pa.array([r[2] for r in rows], pa.binary())})
    path = str(tmp_path / "in.parquet")
    pq.write_table(t.replace_schema_metadata({"geo": json.dumps(geo("Polygon", crs=None, future=1)), "other": "kept"}), path)
    return path, t


def test_convert_and_validate(spark, tmp_path):
    source, t = grid_file(tmp_path)
    out = str(tmp_path / "out.parquet")
    o = Options((2.0, 1.0, 0.5, 0.25, 0.01), min_root_features=1, row_group_size=8, page_rows=2, tolerance_factor=1.0, polygon_factor=4.0)
    assert convert_file(spark, source, out, o).first().rows == 40
    report = check(spark, out)
    assert report.valid and report.overviews_validated, report.text()
    md = pq.read_metadata(out).metadata
    g = json.loads(md[b"geo"])
    assert md[b"other"] == b"kept" and g["columns"]["geometry"]["future"] == 1 and g["columns"]["geometry"]["crs"] is None
    assert g["columns"]["geometry"]["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]
    table = LodTable.open(spark, out)
    got = table.read(columns=["id", "name"]).orderBy("id").collect()
    assert [(r.id, r.name) for r in got] == list(zip(t["id"].to_pylist(), t["name"].to_pylist()))
    near = table.read(bbox=(0, 0, 2.2, 0.2), columns=["id"]).collect()
    assert sorted(r.id for r in near) == [0, 1, 2]
    assert table.read(max_rows=5, columns=["id"]).count() == 5
    over = table.read(table.select_level(0.25), use_overview=True, columns=["id"])
    assert over.where("geometry.parts IS NULL").count() == 0
    assert table.read_row(39, ["id"]).count() == 1 and table.inspect()["rows"] == 40
    plan = table.scan().where(F.col("bbox.xmin") > 5).select("bbox.xmin")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(bbox.xmin), GreaterThan(bbox.xmin,5.0)]" in plan and "struct<xmin:double>" in plan
    tile = render_tile(spark, tile_url({"a": {"url": out}}).format(z=4, x=8, y=7), {})
    assert tile
    with pytest.raises(IndexError):
        table.read(max_level=9)
    with pytest.raises(IndexError):
        table.read_row(40)


def test_lossless_with_nulls_empties_and_covering(spark, tmp_path):
    empty = write(Geometry(3, []))
    rows = [(0, box(0, 0, 1), None), (1, None, "x"), (2, empty, None), (3, box(0, 0, 1), None)]
    df = spark.createDataFrame([(i, w and bytearray(w), b) for i, w, b in rows], "fid long, geometry binary, bbox string")
    out = str(tmp_path / "o.parquet")
    convert(df, out, geo("Polygon", crs=None) | {"lod": {"stale": 1}}, Options((1.0, 0.1), min_root_features=1))
    assert check(spark, out).valid
    back = spark.read.parquet(out).select("geometry", "bbox")
    want = df.select("geometry", "bbox")
    assert back.exceptAll(want).count() == 0 == want.exceptAll(back).count()
    assert "bbox_" in spark.read.parquet(out).columns


def test_existing_covering_is_trusted(spark, tmp_path):
    df = spark.range(16).select(F.col("id").alias("fid"), F.col("id").alias("k"))
    wkb = {i: box(i, 0, 0.5) for i in range(16)}
    df = spark.createDataFrame([(i, i, (i + 100.0, 0.0, i + 100.5, 0.5), bytearray(wkb[i])) for i in range(16)], "fid long, id long, extent struct<xmin:double,ymin:double,xmax:double,ymax:double>, geometry binary")
    g = geo("Polygon", covering={"bbox": {c: ["extent", c] for c in ("xmin", "ymin", "xmax", "ymax")}})
    out = str(tmp_path / "o.parquet")
    convert(df, out, g, Options((1.0, 0.1), min_root_features=1, row_group_size=4))
    t = LodTable.open(spark, out)
    assert t.read(bbox=(100, 0, 101.2, 1), columns=["id"]).count() == 2 and "bbox" not in t.columns
    assert t.inspect()["bbox"] == [100.0, 0.0, 115.5, 0.5]


def test_empty_input_and_options(spark, tmp_path):
    df = spark.createDataFrame([], "fid long, geometry binary")
    out = str(tmp_path / "o.parquet")
    convert(df, out, geo("Point") | {"lod": {}}, Options((1.0,)))
    assert "lod" not in json.loads(pq.read_metadata(out).metadata[b"geo"]) and check(spark, out).valid
    for bad in (Options((1.0, 1.0)), Options((1.0, 2.0)), Options((float("nan"),)), Options(()), Options((1.0,), row_group_size=0), Options((1.0,), thinning_factor=0), Options(min_zoom=5, max_zoom=3), Options((1.0,), zstd_level=30)):
        with pytest.raises(ValueError):
            bad.ladder()


def test_broken_files_are_reported(spark, tmp_path):
    source, t = grid_file(tmp_path)
    assert not check(spark, source).valid
    for lod in ({"levels": [{"row_group_end": 1, "resolution": 1}]}, {"levels": []}, {"levels": [{"row_group_end": 0, "resolution": 1}], "overviews": None}):
        path = str(tmp_path / "bad.parquet")
        pq.write_table(t.replace_schema_metadata({"geo": json.dumps(geo("Polygon") | {"lod": lod})}), path)
        assert not check(spark, path).valid
    ok = {"levels": [{"row_group_end": 0, "resolution": 1}], "overviews": {"encoding": "new", "column": "x", "lods": {"a": {"level_indices": [0]}}}}
    pq.write_table(t.replace_schema_metadata({"geo": json.dumps(geo("Polygon") | {"lod": ok})}), path)
    report = check(spark, path)
    assert report.valid and report.warnings and not report.overviews_validated


def test_urls():
    url = tile_url({"b": {"url": "u", "properties": {}}, "a": {"url": "v"}})
    assert url == tile_url({"a": {"url": "v"}, "b": {"url": "u", "properties": {}}})
    layers, *at = parse_tile_url(url.format(z=3, x=7, y=0))
    assert [one["name"] for one in layers] == ["a", "b"] and at == [3, 7, 0]
    for bad in (url.format(z=3, x=8, y=0), url.format(z=25, x=0, y=0), "x"):
        with pytest.raises(ValueError):
            parse_tile_url(bad)


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(bytearray(box(1, 2, 4)),)], "w binary").createOrReplaceTempView("w")
    r = spark.sql("SELECT lod_bbox(w) AS b, lod_kind(w) AS k, lod_geojson(w) AS j, lod_overview(w, 1.0D) AS o, length(lod_mvt_geometry(w, 0, 0, 0)) AS m FROM w").first()
    assert (r.b.xmin, r.b.ymax, r.k) == (1.0, 6.0, 2) and json.loads(r.j)["type"] == "Polygon" and r.o and r.m > 0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, bytearray(box(i, 0, 0.5))) for i in range(20)], "id long, geometry binary")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    (tmp_path / "out").mkdir()
    q = convert_stream(stream, str(tmp_path / "out"), geo("Polygon"), Options((1.0, 0.1), min_root_features=1)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    files = list((tmp_path / "out").iterdir())
    assert files and sum(pq.read_metadata(f).num_rows for f in files) == 20 and check(spark, str(files[0])).valid


def test_bbox_self_join_has_every_pair(spark, tmp_path):
    rows = [(i, i * 613 % 400, float(100_000 + i * 7919 % 400_000)) for i in range(1, 1800)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    boxes = queries.g3(spark, str(tmp_path)).collect()
    want = {(a.fid, b.fid) for a in boxes for b in boxes if a.fid < b.fid and a.xmax >= b.xmin and a.xmin <= b.xmax and a.ymax >= b.ymin and a.ymin <= b.ymax}
    got = [tuple(r) for r in queries.bbox_self_join(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) > 100 and set(got) == want


def test_mvt_tiles_render_every_point(spark, monkeypatch, tmp_path):
    n = 9000
    rows = [(i, i * 31 % 500, "click", float(i % 97)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    tiles, render = [], queries.T.render_tiles
    monkeypatch.setattr(queries.T, "render_tiles", lambda *a, **b: tiles.append(render(*a, **b)) or tiles[-1])
    sizes = {(r.tile_x, r.tile_y): r.bytes for r in queries.mvt_tiles(spark, str(tmp_path)).collect()}
    got = {(r.tile_x, r.tile_y): bytes(r.tile) for r in tiles[0].collect()}
    seen = sorted(f["id"] for t in got.values() for f in decode(t)["events"]["features"])
    assert seen == list(range(n)) and sizes == {k: len(v) for k, v in got.items()}


def lines_file(spark, tmp_path, files=1):
    rng = random.Random(17)
    rows = []
    for i in range(60):
        x, y, n = rng.uniform(-80, 80), rng.uniform(-60, 60), rng.randint(2, 9)
        line = np.array([(x + k * rng.uniform(0.1, 4), y + rng.uniform(-2, 2)) for k in range(n)])
        rows.append((i, i, f"n{i}", write(Geometry(2, [[line]]))))
    df = spark.createDataFrame(rows, "fid long, id long, name string, geometry binary").withColumn("tags", F.struct(F.col("name").alias("a"), F.col("id").alias("b")))
    path = str(tmp_path / ("lines.parquet" if files == 1 else "lines"))
    convert(df, path, geo("LineString"), Options((8.0, 2.0, 0.5), row_group_size=7, page_rows=2, min_root_features=1, line_factor=1.0, files=files)).count()
    return path


def test_an_overview_read_fetches_one_rendering(spark, tmp_path):
    t = LodTable.open(spark, lines_file(spark, tmp_path))
    df = t.read(0, None, ["tags.b"], use_overview=True)
    assert df.count() == t.level_ends()[0] > 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "geometry#" in plan  # the decoded column, not the file's
    one, all_of_it = t.traced(0, None, ["tags.b", "overviews.l0"]), t.traced(0, None, ["tags", "overviews", "geometry"])
    assert one["row_groups"] == all_of_it["row_groups"] and one["bytes"] < all_of_it["bytes"] / 3
    with pytest.raises(MetaError):
        t.check_protected(["id", "geometry"], {"geometry"})
    source = pruned(plain(t.arrow_schema), ["tags.b", "overviews.l0"])
    assert [f.name for f in source.field("overviews").type] == ["l0"] and [f.name for f in source.field("tags").type] == ["b"]


def test_a_box_and_a_limit_reach_the_file(spark, tmp_path):
    path = lines_file(spark, tmp_path)
    t = LodTable.open(spark, path)
    every = t.scan().collect()
    for box in ((-20, -20, 30, 30), (0, 0, 1, 1), (-500, -500, 500, 500), (300, 300, 301, 301)):
        hit = [r.id for r in every if r.bbox.xmax >= box[0] and r.bbox.xmin <= box[2] and r.bbox.ymax >= box[1] and r.bbox.ymin <= box[3]]
        assert [r.id for r in t.read(bbox=box, columns=["id"], geometry=False).orderBy("row_index").collect()] == hit
        assert [r.id for r in t.read(bbox=box, columns=["id"], geometry=False, max_rows=5).orderBy("row_index").collect()] == hit[:5]
        source = read_row_groups(spark, path, t.parts(t.candidates(None, box)), ["bbox", "id"], t.geo.covering, box)
        assert sorted(r.id for r in source.collect()) == sorted(hit)  # nothing else leaves the file
    assert read_row_groups(spark, path, t.parts(range(t.num_row_groups)), ["id"], limit=2).count() == 2 * t.num_row_groups
    assert [r.id for r in t.read(columns=["id"], geometry=False, max_rows=11).orderBy("row_index").collect()] == [r.id for r in every[:11]]


def test_many_files_are_one_table(spark, tmp_path):
    one, many = LodTable.open(spark, lines_file(spark, tmp_path)), LodFolder.open(spark, lines_file(spark, tmp_path, files=3))
    assert len(many.tables) == 3 and many.inspect()["rows"] == 60
    for level in range(3):
        for box in (None, (-30, -30, 20, 20)):
            for overview in (False, True):
                rows = lambda t: sorted((r.id, str(r.geometry)) for r in t.read(level, box, ["id"], use_overview=overview).collect())
                assert rows(many) == rows(one)
    read = many.read(columns=["id"], geometry=False)
    assert sorted(r.row_index for r in read.collect()) == list(range(60))
    assert many.read_row(37, ["id"]).count() == 1 and many.read(columns=["id"], geometry=False, max_rows=4).count() == 4
    o = Options((1.0,), rows_per_file=10)
    assert [o.files_for("x.parquet", 99), o.files_for("x", 99), o.files_for("x", 3), Options((1.0,), files=1).files_for("x", 9), Options((1.0,), files=5).files_for("x.parquet", 9)] == [0, 10, 1, 0, 5]
    with pytest.raises(MetaError):
        LodFolder([one, LodTable.open(spark, converted_points(spark, tmp_path))])


def converted_points(spark, tmp_path):
    path = str(tmp_path / "points.parquet")
    df = spark.createDataFrame([(i, i, write(Geometry(1, [[np.array([[i, i]], float)]]))) for i in range(9)], "fid long, id long, geometry binary")
    convert(df, path, geo("Point"), Options((1.0,), row_group_size=4, page_rows=2)).count()
    return path


def test_a_folder_is_numbered_file_by_file(spark, tmp_path):
    for k in range(3):
        t = pa.table({"id": list(range(10 * k, 10 * k + 5 + k)), "geometry": pa.array([write(Geometry(1, [[np.array([[i, k]], float)]])) for i in range(5 + k)], pa.binary())})
        (tmp_path / "in").mkdir(exist_ok=True)
        pq.write_table(t.replace_schema_metadata({"geo": json.dumps(geo("Point"))}), tmp_path / "in" / f"{k}.parquet")
    out = str(tmp_path / "out.parquet")
    assert convert_file(spark, str(tmp_path / "in"), out, Options((4.0, 1.0), row_group_size=5, page_rows=2, min_root_features=1)).first().rows == 18
    assert sorted(r.id for r in LodTable.open(spark, out).read(columns=["id"]).collect()) == sorted(i for k in range(3) for i in range(10 * k, 10 * k + 5 + k))


def test_layout_report(spark, tmp_path):
    one = LodTable.open(spark, lines_file(spark, tmp_path))
    many = LodFolder.open(spark, lines_file(spark, tmp_path, files=3))
    boxes = spark.createDataFrame([(0, -20.0, -20.0, 30.0, 30.0), (1, 500.0, 500.0, 501.0, 501.0)], "q int, qx0 double, qy0 double, qx1 double, qy1 double")
    report = layout_report({"one": one, "many": many}, boxes)
    hit = lambda t: [sum(g["xmax"] >= -20 and g["xmin"] <= 30 and g["ymax"] >= -20 and g["ymin"] <= 30 for g in t.groups), 0]
    for name, t in (("one", one), ("many", many)):
        assert report[name]["rows"] == 60 and report[name]["row_groups"] == len(t.groups) and report[name]["hits_mean"] == sum(hit(t)) / 2
    text = markdown(report)
    assert text.startswith("| figure | one | many | change |") and len(text.split("\n")) == 2 + 9 and "| rows | 60 | 60 | +0.0% |" in text


@pytest.mark.parametrize("by", [["k"], []])
def test_merged_ranges_equal_brute_force(spark, by):
    rng = random.Random(27)
    rows = [(rng.choice([None, "a", "b"]), a, a + rng.randint(1, 40)) for a in (rng.randrange(3000) for _ in range(200))]
    merged = S.merge_ranges(spark.createDataFrame(rows, "k string, start long, stop long"), 5, by)
    got = sorted((*(str(r[k]) for k in by), r.start, r.stop, r.n) for r in merged.collect())
    want = []
    for k in ([None, "a", "b"] if by else [0]):
        out = []
        for a, b in sorted((a, b) for x, a, b in rows if not by or x == k):
            if out and a <= out[-1][1] + 5:
                out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + 1)
            else:
                out.append((a, b, 1))
        want += [(str(k), *x) for x in out] if by else out
    assert got == sorted(want)


def test_a_file_of_many_shares(spark, tmp_path, monkeypatch):
    """FINDINGS_r03 F7, F10, F11: one task sorted and wrote a file's rows; each row group was a task that read the footer."""
    from lodestrata.sources import writer

    df = spark.range(700).selectExpr("id AS fid", "id", "(id * 37 % 360) - 180.0D AS x", "(id * 53 % 170) - 85.0D AS y")
    df = df.withColumn("geometry", queries.to_wkb(F.lit(1), F.array(F.array(F.array(F.struct("x", "y"))))))
    for files in (1, 3):
        at = []
        for n in (250_000, 60):
            monkeypatch.setattr(writer, "SHARE_ROWS", n)
            out = str(tmp_path / f"{files}-{n}{'.parquet' if files == 1 else ''}")
            assert sum(r.rows for r in convert(df, out, queries.geo("Point"), Options((8.0, 2.0, 0.5), row_group_size=20, page_rows=5, min_root_features=1, files=files)).collect()) == 700
            t = (LodTable if files == 1 else LodFolder).open(spark, out)
            read = t.read(columns=["id"])
            assert t.num_row_groups >= 35 and read.rdd.getNumPartitions() == 1
            at.append([r.id for r in read.orderBy("row_index").collect()])
        assert at[0] == at[1] and sorted(at[0]) == list(range(700))
    t = LodTable.open(spark, str(tmp_path / "1-60.parquet"))
    assert [t.read_row(i, ["id"]).collect() for i in (0, 333, 699)] == [[(i, LodTable.read(t, columns=["id"]).where(f"row_index = {i}").first().id)] for i in (0, 333, 699)]


def test_joins_of_rows_are_no_broadcasts(spark):
    """FINDINGS_r03 F1: Spark took compressed tables for small ones and gathered their rows on the driver."""
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "fid long, v double")
    assert "SortMergeJoin" in A.priority_rank(df, "v")._jdf.queryExecution().executedPlan().toString()
    boxes = spark.range(3).selectExpr("id AS fid", "0D AS xmin", "0D AS ymin", "1D AS xmax", "1D AS ymax")
    assert "Broadcast" not in bbox_join(boxes, boxes, 4.0)._jdf.queryExecution().executedPlan().toString()
