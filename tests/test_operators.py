"""Operators without a SQL twin against plain Python, and hand-made edge rows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import boxes as B
from tessella.functions import geo
from tessella.functions import rings as R
from tessella.operators import etl, evaluation, sampling, suppression
from tessella.operators.numbering import number_rows
from tessella.plans import registry
from tessella.plans.fixtures import Fixtures
from tessella.sources import coco, logs
from tessella.streaming import meters
from tests.brute import cells_iou, fill_cells

c = F.col


def ring_df(spark, rings):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)], "id long, ring array<struct<x:double,y:double>>")


def pts(ring):
    return [(p["x"], p["y"]) for p in ring]


def test_ring_edges(spark):
    rings = [[], [(1, 1)], [(0, 0), (2, 0)], [(3, 3)] * 4, [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0.05)], [(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (1, 0), (2, 0), (3, 0)]]
    rows = ring_df(spark, rings).select(
        "id", R.polygon_area(c("ring")).alias("area"), F.size(R.remove_close_vertices(c("ring"))).alias("kept"), R.is_self_intersecting(c("ring")).alias("cross"), R.canonical_start(c("ring")).alias("start"), R.resample_polygon(c("ring"), 8).alias("r")
    ).orderBy("id").collect()
    assert [round(r.area, 3) for r in rows] == [0, 0, 0, 0, 12.0, 0, 0]
    assert [r.kept for r in rows] == [0, 0, 2, 0, 4, 4, 4]
    assert [r.cross for r in rows] == [False, False, False, True, False, True, True]
    assert rows[0].start == [] and pts(rows[2].start)[0] == (0.0, 0.0)
    assert rows[0].r.ring == [] and pts(rows[2].r.ring) == [(0.0, 0.0)] * 8 and sum(rows[2].r.corners) == 0
    assert pts(rows[3].r.ring) == [(3.0, 3.0)] * 8
    assert len(rows[5].r.ring) == 8 and sum(rows[5].r.corners) >= 3


def test_simplify_keeps_far_points(spark):
    ring = [(0, 0), (1, 0.001), (2, 0), (2, 1), (2, 2), (2, 3), (0, 3)]
    row = ring_df(spark, [ring]).select(R.simplify_polygon(c("ring"), 0.01).alias("r")).first()
    assert pts(row.r) == [(0, 0), (2, 0), (2, 3), (0, 3)]


def test_box_nms_is_greedy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 5), i, float(rng.integers(0, 6)) / 5, *map(float, (x := rng.integers(0, 40, 2))), *map(float, x + rng.integers(4, 30, 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, score double, x1 double, y1 double, x2 double, y2 double").withColumn("box", F.struct("x1", "y1", "x2", "y2"))
    got = {r.det_id for r in suppression.box_nms(df, 0.4).collect()}

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        i = max(w, 0) * max(h, 0)
        return i / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i)

    want = set()
    for image in range(5):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1])):
            if all(iou(k, r) <= 0.4 for k in kept):
                kept.append(r)
        want |= {k[1] for k in kept}
    assert got == want


def test_hungarian_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (5, 3), (4, 4)):
        cost = rng.normal(size=(n, m))
        pairs = suppression.hungarian(cost)
        best = min(sum(cost[i, j] for i, j in zip(a, b)) for a in itertools.permutations(range(n), min(n, m)) for b in [range(min(n, m))]) if n >= m else min(sum(cost[i, j] for i, j in enumerate(b)) for b in itertools.permutations(range(m), n))
        assert len(pairs) == min(n, m) and math.isclose(sum(cost[i, j] for i, j in pairs), best)


def test_assignment_of_all_boxes(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    got = registry.QUERIES["p8_assign_pairs"](spark, sf_dir).collect()
    n, m = ({r.image_id: r["count"] for r in d.groupBy("image_id").count().collect()} for d in (fx.detections, fx.objects))
    pairs = pd.Series([r.image_id for r in got]).value_counts().to_dict()
    assert pairs == {i: min(n[i], m[i]) for i in n.keys() & m.keys()} and max(pairs.values()) > 8
    assert len({r.query_id for r in got}) == len({r.gt_id for r in got}) == len(got)


def test_assignment_against_brute_force(spark):
    """Nine predictions and seven objects, with costs in plain Spark columns."""
    rng = np.random.default_rng(4)
    box = lambda: (*map(float, x := rng.integers(0, 60, 2)), *map(float, x + rng.integers(5, 30, 2)))
    q = spark.createDataFrame([(1, i, float(rng.uniform(0.05, 0.95)), box(), 100, 80) for i in range(9)], "image_id long, query_id long, p double, box struct<x1:double,y1:double,x2:double,y2:double>, width int, height int")
    t = spark.createDataFrame([(1, i, box()) for i in range(7)] + [(2, 9, box())], "image_id long, gt_id long, box struct<x1:double,y1:double,x2:double,y2:double>")
    both = q.join(t.withColumnRenamed("box", "tb"), "image_id").withColumns({"a": B.normalize_box(c("box"), c("width"), c("height")), "b": B.normalize_box(c("tb"), c("width"), c("height"))})
    l1 = sum((F.abs(c("a")[k] - c("b")[k]) for k in ("cx", "cy", "w", "h")), F.lit(0.0))
    focal = 0.25 * (1 - c("p")) ** 2 * -F.ln(c("p") + 1e-8) - 0.75 * c("p") ** 2 * -F.ln(1 - c("p") + 1e-8)
    cost = np.zeros((9, 7))
    for r in both.select("query_id", "gt_id", (5 * l1 + 2 * focal - 2 * B.generalized_box_iou(c("box"), c("tb"))).alias("cost")).collect():
        cost[r.query_id, r.gt_id] = r.cost
    got = suppression.assign_pairs(q, t).collect()
    assert len(got) == 7 and all(r.image_id == 1 and math.isclose(r.cost, cost[r.query_id, r.gt_id], abs_tol=1e-9) for r in got)
    order = np.array(list(itertools.permutations(range(9), 7)))
    assert math.isclose(sum(r.cost for r in got), cost[order, np.arange(7)].sum(axis=1).min(), abs_tol=1e-9)


def test_polygon_iou_and_nms(spark):
    square = lambda x: [{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0))]
    df = spark.createDataFrame([(1, 1, square(0.0), 160, 160, 0.9), (1, 2, square(20.0), 160, 160, 0.8), (1, 3, square(100.0), 160, 160, 0.7)], "image_id long, id long, ring array<struct<x:double,y:double>>, width int, height int, score double")
    assert [(r.id_a, r.id_b, round(r.iou, 6)) for r in suppression.polygon_iou(df).collect()] == [(1, 2, round(1 / 3, 6))]
    assert sorted(r.id for r in suppression.polygon_nms(df).collect()) == [1, 3]


def test_polygon_queries_run_on_whole_tables(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    drawn = {r.id for r in registry.QUERIES["p3_extract_polygon"](spark, sf_dir).select("id").collect()}
    assert drawn == {r.det_id for r in fx.detections.select("det_id").collect()}
    rings = fx.rings.join(fx.images, "image_id").where("image_id <= 8").orderBy("ann_id").collect()
    cells = [(r.image_id, r.ann_id, fill_cells(r.ring, r.width, r.height, 4)) for r in rings]
    want = {(i, a, b): v for (i, a, p), (j, b, q) in itertools.combinations(cells, 2) if i == j and (v := cells_iou(p, q)) > 0}
    got = {(r.image_id, r.id_a, r.id_b): r.iou for r in registry.QUERIES["p4_polygon_iou"](spark, sf_dir).where("image_id <= 8").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 50


def test_coco_single_category(spark):
    det = pd.DataFrame([(1, 0, 1, 0.9, 0, 0, 10, 10), (1, 0, 2, 0.8, 0, 0, 10, 9), (1, 0, 3, 0.7, 50, 50, 60, 60), (2, 0, 4, 0.6, 0, 0, 10, 10)], columns=["image_id", "category_id", "det_id", "score", "x1", "y1", "x2", "y2"])
    gt = pd.DataFrame([(1, 0, 0, 0, 0, 10, 10), (2, 0, 0, 0, 0, 10, 10), (2, 0, 1, 30, 30, 60, 60)], columns=["image_id", "category_id", "iscrowd", "x1", "y1", "x2", "y2"])
    d, g = spark.createDataFrame(det).withColumn("category_id", c("category_id").cast("int")), spark.createDataFrame(gt).withColumn("category_id", c("category_id").cast("int"))
    s = {r.metric: r.value for r in evaluation.coco_summary(d, g).collect()}
    # tp fp fp tp over two objects: precision 1 up to recall .5, then 2/4
    assert math.isclose(s["AP"], (51 + 50 * 0.5) / 101, abs_tol=1e-9)
    assert s["AR@1"] == 1.0 and s["AP_large"] == -1.0 and s["AP_small"] == s["AP"]


def test_tiles_of_small_and_exact_images(spark):
    images = spark.createDataFrame([(1, "a.jpg", 100, 100), (2, "b.jpg", 128, 128), (3, "c.jpg", 300, 128)], "image_id long, file_name string, width int, height int")
    rows = {(r.image_id, r.r, r.c): (r.tx0, r.ty0, r.tile) for r in etl.tile_images(images).collect()}
    assert rows[(1, 0, 0)] == (0, 0, "a_crop_0_0") and rows[(2, 0, 0)] == (0, 0, "b_crop_0_0")
    assert sorted(k[2] for k in rows if k[0] == 3) == [0, 1, 2] and rows[(3, 0, 2)][0] == 430
    with pytest.raises(ValueError):
        etl.tile_images(images, overlap=320)


def test_geo_errors_and_limits(spark):
    df = spark.createDataFrame([("bad", 10.0, 0.0, 5.0, 1.0, 10)], "name string, min_lon double, min_lat double, max_lon double, max_lat double, zoom int")
    with pytest.raises(Exception, match="not a region"):
        geo.tile_cover(df).collect()
    r = spark.range(1).select(geo.lonlat_to_tile(F.lit(180.0), F.lit(85.0511), F.lit(3)).alias("t"), geo.gcj02_to_wgs84(F.lit(10.0), F.lit(50.0)).alias("g")).first()
    assert math.isclose(r.t.x, 8) and abs(r.t.y) < 1e-4 and (r.g.lon, r.g.lat) == (10.0, 50.0)


def test_numbering(spark):
    df = spark.createDataFrame([(i % 3, "x") for i in range(50)], "k long, v string")
    rows = number_rows(df, [c("k").asc()], "n", "total").collect()
    assert sorted(r.n for r in rows) == list(range(50)) and {r.total for r in rows} == {50}
    assert [r.k for r in sorted(rows, key=lambda r: r.n)] == sorted(i % 3 for i in range(50))
    assert number_rows(df.limit(0), [c("k").asc()], "n").count() == 0


def test_shards_are_equal(spark):
    df = spark.range(23).withColumnRenamed("id", "image_id")
    a = sampling.epoch_shards(df, "image_id", 1, 4).collect()
    assert sorted(pd.Series([r.shard for r in a]).value_counts()) == [6] * 4 and {r.image_id for r in a} == set(range(23))
    assert [r.image_id for r in sorted(a, key=lambda r: r.pos)] != list(range(23))


def test_panoptic_and_manifest(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"images":[{"id":2,"file_name":"b.jpg"},{"id":1,"file_name":"a.jpg"}],"annotations":[{"file_name":"a.png","image_id":1,"segments_info":[{"id":7,"category_id":3,"iscrowd":0,"area":4}]},{"file_name":"b.png","image_id":2,"segments_info":[]}]}')
    rows = coco.read_panoptic(spark, str(tmp_path / "p.json")).collect()
    assert [(r.image_id, r.segment_id, r.area) for r in rows] == [(1, 7, 4)]
    (tmp_path / "q.json").write_text('{"images":[{"id":1,"file_name":"a.jpg"}],"annotations":[{"file_name":"z.png","image_id":1,"segments_info":[{"id":7,"category_id":3,"iscrowd":0,"area":4}]}]}')
    with pytest.raises(Exception, match="stems disagree"):
        coco.read_panoptic(spark, str(tmp_path / "q.json")).collect()
    for n in ("b.jpg", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    m = coco.image_manifest(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.file_name, r.width) for r in m] == [(0, "a.png", 320), (1, "b.jpg", 320)]


def test_threshold_log_errors(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("epoch\traw_threshold\n1\t0.5\n")
    with pytest.raises(ValueError, match="target_ema_threshold"):
        logs.read_threshold_log(spark, str(tmp_path / "t.tsv"))


def test_new_files_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in ("b.jpg", "a.png", "c.txt"):
        (src / n).write_bytes(b"xy")
    got = meters.drain(meters.new_files(spark, str(src)), spark, str(tmp_path / "run")).collect()
    assert sorted((r.file_name, r.length) for r in got) == [("a.png", 2), ("b.jpg", 2)]


def test_entry_imports_without_the_llm_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and int(out.stdout) > 80, out.stderr


def test_stored_tables_can_be_discarded(spark, sf_dir):
    from tessella.sources.shared import discard, materialize

    one = materialize(spark.range(10).toDF("x"))
    two = materialize(one.where("x > 3"))
    discard(one, spark.read.parquet(f"{sf_dir}/region.parquet"))
    assert two.count() == 6 and spark.read.parquet(f"{sf_dir}/region.parquet").count() == 5
    with pytest.raises(Exception):
        one.withColumn("y", F.col("x")).collect()


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from tessella.sources.shared import shared_dir

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("spark://host:7077", "hdfs:///x/")) == "hdfs:///x"
    assert shared_dir(session("local[4]", None)).startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077", None))
