"""Views over the driver tables in the shapes that the operators expect; one SQL text for Spark and DuckDB."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "lineitem", "orders", "events", "embeddings")
VIEWS = {
    "fx_images": """SELECT c_custkey AS image_id, concat('tile_', CAST(c_custkey AS STRING), '.jpg') AS file_name,
        CAST(320 + 80*(c_custkey % 3) AS INT) AS width, CAST(320 + 40*(c_custkey % 4) AS INT) AS height FROM customer""",
    "fx_objects": """SELECT l_orderkey*10 + l_linenumber AS ann_id, o_custkey AS image_id, CAST(l_suppkey % 2 AS INT) AS category_id,
        CAST((l_partkey*37 + l_orderkey*3) % 260 AS DOUBLE) AS x, CAST((l_suppkey*53 + l_linenumber*17 + l_orderkey) % 260 AS DOUBLE) AS y,
        CAST(8 AS DOUBLE) + l_quantity AS w, CAST(8 + l_partkey % 40 AS DOUBLE) AS h,
        CAST(CASE WHEN l_partkey % 20 = 0 THEN 1 ELSE 0 END AS INT) AS iscrowd
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity
          FROM lineitem GROUP BY l_orderkey, l_linenumber) k JOIN orders ON l_orderkey = o_orderkey""",
    "fx_detections": """SELECT ann_id AS det_id, image_id, category_id, x + CAST((ann_id*7) % 9 - 4 AS DOUBLE) AS x,
        y + CAST((ann_id*5) % 7 - 3 AS DOUBLE) AS y, w + CAST(ann_id % 3 AS DOUBLE) AS w, h + CAST(ann_id % 2 AS DOUBLE) AS h,
        CAST((ann_id*7919) % 99991 AS DOUBLE) / 99991 AS score FROM fx_objects WHERE ann_id % 10 <> 3""",
    "fx_class_probs": """SELECT det_id, image_id, score AS p0, CAST((det_id*104729) % 99991 AS DOUBLE) / 99991 AS p1 FROM fx_detections""",
    "fx_points": """SELECT c_custkey AS point_id, CAST(73 AS DOUBLE) + CAST((c_custkey*97) % 6000 AS DOUBLE)/100 AS lon,
        CAST(5 AS DOUBLE) + CAST((c_custkey*61) % 4500 AS DOUBLE)/100 AS lat FROM customer""",
    "fx_steps": """SELECT user_id AS run_id, event_id AS step, event_type AS metric, value FROM events""",
    # a run is a block of 200 events, so the number of runs grows with the table
    "fx_epochs": """SELECT run_id + 10*CAST(floor(nth / 200.0) AS BIGINT) AS run_id, CAST(nth % 200 AS INT) AS epoch, conf_mean, conf_kept, n_pseudo, CASE WHEN nth % 10 = 9 THEN src_ap END AS src_ap,
        CASE WHEN nth % 200 > 0 THEN stability END AS stability FROM (SELECT user_id % 10 AS run_id,
          row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS nth,
          CAST(0.15 AS DOUBLE) + CAST((event_id*104729) % 1000 AS DOUBLE)/5000 AS conf_mean,
          CAST(0.4 AS DOUBLE) + CAST((event_id*7919) % 1000 AS DOUBLE)/2500 AS conf_kept,
          CAST((event_id*31) % 40 AS DOUBLE)/2 AS n_pseudo, CAST(0.3 AS DOUBLE) + CAST((event_id*13) % 100 AS DOUBLE)/1000 AS src_ap,
          CAST((event_id*17) % 1000 AS DOUBLE)/1000 AS stability FROM events) e""",
    # one run has a third of all rows, the others are short
    "fx_long_epochs": """SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS INT) AS epoch, conf_kept FROM (
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(floor(event_id / 100.0) AS BIGINT) END AS run_id, CAST(0.4 AS DOUBLE) + CAST((event_id*7919) % 1000 AS DOUBLE)/2500 AS conf_kept FROM events) e""",
    "fx_segments": """SELECT image_id, pred_seg, gt_seg, CAST(pred_seg % 3 AS INT) AS pred_cat, CAST(gt_seg % 3 AS INT) AS gt_cat,
        count(*) AS pixels FROM (SELECT o_custkey AS image_id, l_linenumber AS pred_seg,
          CASE WHEN l_partkey % 5 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS gt_seg
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey) p GROUP BY image_id, pred_seg, gt_seg""",
    "fx_label_pixels": """SELECT DISTINCT o_custkey AS image_id, CAST(l_linenumber AS INT) AS label, CAST((l_partkey*37) % 64 AS INT) AS px,
        CAST((l_suppkey*53) % 64 AS INT) AS py FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}
CORNERS = (("x", "y"), ("x+w", "y"), ("x+w", "y+h/2"), ("x+w/2", "y+h/2"), ("x+w/2", "y+h"), ("x", "y+h"))
RING_SPARK = "array(" + ", ".join(f"named_struct('x',{a},'y',{b})" for a, b in CORNERS) + ")"
RINGS_SPARK = f"SELECT ann_id, image_id, w, h, {RING_SPARK} AS ring FROM fx_objects"
RINGS_DUCK = "SELECT ann_id, image_id, w, h, [" + ", ".join(f"{{'x':{a},'y':{b}}}" for a, b in CORNERS) + "] AS ring FROM fx_objects"


class Fixtures:
    """Attribute access to the views (``fx.objects``) and tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @functools.cache  # noqa: B019
    def table(self, name: str) -> DataFrame:
        if name in VIEWS or name == "fx_rings":
            text = RINGS_SPARK if name == "fx_rings" else VIEWS[name]
            used = {t for t in (*TABLES, *VIEWS) if re.search(rf"\b{t}\b", text)}
            for t in used:
                text = re.sub(rf"\b{t}\b", f"{{{t}}}", text)
            return self.spark.sql(text, **{t: self.table(t) for t in used})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(f"fx_{name}" if f"fx_{name}" in {*VIEWS, "fx_rings"} else name)


def duck(sql: str) -> str:
    """``sql`` with the views that it uses in front."""
    all_views = {**VIEWS, "fx_rings": RINGS_DUCK}
    needed: list[str] = []

    def need(text: str) -> None:
        for v in all_views:
            if re.search(rf"\b{v}\b", text) and v not in needed:
                need(all_views[v])
                needed.append(v)

    need(sql)
    views = ", ".join(f"{v} AS ({all_views[v]})" for v in needed)
    if not views:
        return sql
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {views}, {body[14:]}"
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
