"""Large documents in pieces, and documents written line by line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import sampling
from tessella.sources import coco


def rows(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.drop("document").collect()))


def awkward(n, seed):
    rng = random.Random(seed)
    names = ['a}b.jpg', 'quote " in {name}.jpg', 'back\\\\slash\\\\".jpg', "é}{.jpg", "plain.jpg", '", "annotations": [{']
    images = [{"id": i, "file_name": rng.choice(names), "width": 5, "height": i} for i in range(n)]
    anns = [{"id": i, "image_id": i % n, "category_id": 1, "bbox": [0, 1.5, 2, 3], "extra": {"deep": [{"x": "}"}, {"y": {}}]} if i % 3 == 0 else "images", "iscrowd": 0} for i in range(4 * n)]
    return images, anns, [{"id": 1, "name": "house", "supercategory": "none"}]


def test_large_documents_in_pieces(spark, tmp_path):
    """Byte ranges of a few hundred bytes; lists in any order, empty lists, other members, two documents."""
    images, anns, cats = awkward(40, 1)
    (tmp_path / "a.json").write_text(json.dumps({"info": {"year": 2020, "by": {"who": "{"}}, "images": images, "annotations": anns, "categories": cats, "licenses": [{"id": 1}]}))
    (tmp_path / "b.json").write_text(json.dumps({"annotations": anns[:7], "note": "[{", "categories": [], "images": images[:3]}, indent=1))
    (tmp_path / "c.json").write_text('{"images": []}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = coco.read_large_coco(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for g, w in zip(got, coco.read_coco(spark, str(tmp_path))):
        assert rows(g) == rows(w)
    assert [g.count() for g in got] == [43, 167, 1]


def test_documents_are_written_by_rows(spark, tmp_path):
    """Several documents of about as many rows, each a valid one; both readers give back what went in."""
    images = spark.range(50).select("id", F.format_string('im"{}\\%d.jpg', "id").alias("file_name"), F.lit(9).alias("width"), F.lit(8).alias("height"))
    ring = F.array(F.array(*[F.lit(float(x)) for x in (0, 0, 4, 0, 4, 4)]))
    anns = spark.range(300).select("id", (F.col("id") % 60).alias("image_id"), F.lit(1).alias("category_id"), F.when(F.col("id") % 7 > 0, ring).alias("segmentation"), F.lit(8.0).alias("area"))
    cats = spark.createDataFrame([(1, "house", None), (2, 'b"', "x")], "id int, name string, supercategory string")
    coco.write_coco(images, anns, cats, str(tmp_path / "d"), rows=100)
    files = [f for f in (tmp_path / "d").glob("shard=*/part-*")]
    docs = [json.loads(f.read_text()) for f in files]
    assert len(docs) == 4 and {len(d["categories"]) for d in docs} == {2}
    assert sorted(i["id"] for d in docs for i in d["images"]) == list(range(50))
    want = [i for i in range(300) if i % 7 and i % 60 < 50]
    assert sorted(a["id"] for d in docs for a in d["annotations"]) == want
    for d in docs:
        assert {a["image_id"] for a in d["annotations"]} <= {i["id"] for i in d["images"]}
    for read in (coco.read_coco, coco.read_large_coco):
        i, a, c = read(spark, str(tmp_path / "d"))
        assert i.count() == 50 and sorted(r.id for r in a.select("id").collect()) == want and c.count() == 8
    coco.write_coco(images.limit(0), anns, cats, str(tmp_path / "e"))
    assert json.loads(next((tmp_path / "e").glob("shard=*/part-*")).read_text())["images"] == []


def test_stored_sample_stays(spark, tmp_path):
    path = str(tmp_path / "subset")
    small, large = spark.range(500), spark.range(2000).withColumn("x", F.lit(1))
    first = {r.id for r in sampling.stored_sample(small, "id", 40, path).collect()}
    assert len(first) == 40 and first == {r.id for r in sampling.hash_sample(small, "id", 40).collect()}
    again = sampling.stored_sample(large, "id", 40, path)
    assert {r.id for r in again.collect()} == first and again.columns == ["id", "x"]
    assert first != {r.id for r in sampling.hash_sample(large, "id", 40).collect()}
    assert sampling.stored_sample(large.where("id >= 400"), "id", 40, path).count() < 40


@pytest.mark.parametrize(("shards", "lists"), [(1, "ia"), (3, "ia"), (3, "i"), (1, "a"), (2, "")])
def test_large_document_in_parts(spark, tmp_path, shards, lists):
    """A document over ``rows`` objects is written by many tasks; its files one after another are the JSON, also with empty lists."""
    ids = list(range(400))
    ring = [[0.0, 0.0, 4.0, 0.0, 4.0, 4.0]]
    images = spark.createDataFrame([(i, f"{{{i}}}\"}}.jpg", 10, 10) for i in ids], "id long, file_name string, width int, height int").where(F.lit("i" in lists))
    anns = spark.createDataFrame([(i * 10 + k, i, ring, float(k)) for i in ids for k in range(3)], "id long, image_id long, segmentation array<array<double>>, area double").where(F.lit("a" in lists))
    cats = spark.createDataFrame([(1, "x", "y")] if lists else [], "id int, name string, supercategory string")
    path = str(tmp_path / "d")
    coco.write_coco(images, anns, cats, path, rows=20, shards=shards)
    found = []
    for folder in sorted((tmp_path / "d").glob("shard=*")):
        files = sorted(folder.rglob("*.txt"), key=lambda f: (int(f.parent.name[5:]) if "part=" in f.parent.name else 0, f.name))
        found.append(json.loads("".join(f.read_text() for f in files)))
        assert len(files) == len({f.parent for f in files}) and (lists != "ia" or max(f.read_text().count('"id":') for f in files) <= 80 and len(files) > 20)
    assert len(found) == shards
    for name, want in (("images", ids if "i" in lists else []), ("annotations", [i * 10 + k for i in ids for k in range(3)] if lists == "ia" else []), ("categories", [1] * shards if lists else [])):
        assert sorted(r["id"] for d in found for r in d[name]) == want
    got = coco.read_large_coco(spark, path)
    assert [t.count() for t in got] == [sum(len(d[n]) for d in found) for n in ("images", "annotations", "categories")]
    assert {r.file_name for r in got[0].collect()} == {r["file_name"] for d in found for r in d["images"]}


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_annotations_meet_their_image(spark, tmp_path, compression):
    """An annotation is in its image's document, whatever integer type names it, or in none; compressed documents read the same."""
    images = spark.range(60).select("id", F.format_string("%d.jpg", "id").alias("file_name"), F.lit(9).alias("width"), F.lit(8).alias("height"))
    ring = F.array(F.array(*[F.lit(float(x)) for x in (0, 0, 4, 0, 4, 4)]))
    to = F.when(F.col("id") % 9 > 0, (F.col("id") % 70).cast("int"))
    anns = spark.range(400).select("id", to.alias("image_id"), ring.alias("segmentation"))
    cats = spark.createDataFrame([(1, "house", "x")], "id int, name string, supercategory string")
    path = str(tmp_path / "d")
    coco.write_coco(images, anns, cats, path, rows=60, **({} if compression == "none" else {"compression": compression}))
    want = [i for i in range(400) if i % 9 and i % 70 < 60]
    for read in (coco.read_coco, coco.read_large_coco):
        i, a, c = (t.collect() for t in read(spark, path))
        assert sorted(r.id for r in i) == list(range(60)) and sorted(r.id for r in a) == want
        assert {(r.document, r.image_id) for r in a} <= {(r.document, r.id) for r in i}
        assert len(c) == len({r.document for r in i}) == 8
    assert {f.suffix for f in (tmp_path / "d").glob("shard=*/part-*")} == {".txt" if compression == "none" else ".gz"}


def test_round_trip_moves_little(spark, sf_dir, monkeypatch):
    """The objects are made once, and what is written of the documents is a fraction of their text."""
    from tessella.plans import registry

    seen, write = [], coco.write_coco

    def spy(images, annotations, categories, path, **how):
        seen.append((path, [t._jdf.queryExecution().optimizedPlan().toString() for t in (annotations, categories)]))
        write(images, annotations, categories, path, **how)

    monkeypatch.setattr(coco, "write_coco", spy)
    assert registry.QUERIES["a1_a2_coco_round_trip"](spark, sf_dir).count() > 0
    ((path, plans),) = seen
    assert not any("Join" in p or "lineitem" in p for p in plans)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = fs.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(fs).getLength()
    text = spark.read.text(path).agg(F.sum(F.length("value") + 1)).first()[0]
    assert 3 * stored < text


def test_compressed_parts(spark, tmp_path):
    """The compressed files of a document in parts are, one after another, the compressed document."""
    import gzip

    ring = [[0.0, 0.0, 4.0, 0.0, 4.0, 4.0]]
    images = spark.createDataFrame([(i, f"{{{i}}}\"}}.jpg", 10, 10) for i in range(90)], "id long, file_name string, width int, height int")
    anns = spark.createDataFrame([(i, i % 100, ring) for i in range(400)], "id long, image_id long, segmentation array<array<double>>")
    cats = spark.createDataFrame([(1, "x", "y")], "id int, name string, supercategory string")
    coco.write_coco(images, anns, cats, str(tmp_path / "d"), rows=50, shards=1, compression="gzip")
    files = sorted((tmp_path / "d").rglob("*.gz"), key=lambda f: int(f.parent.name[5:]))
    document = json.loads(gzip.decompress(b"".join(f.read_bytes() for f in files)))
    want = [list(range(90)), [i for i in range(400) if i % 100 < 90], [1]]
    assert len(files) > 10 and [sorted(r["id"] for r in document[k]) for k in coco.PARTS] == want
    assert [sorted(r.id for r in t.collect()) for t in coco.read_large_coco(spark, str(tmp_path / "d"))] == want
