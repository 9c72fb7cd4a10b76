import base64
import json

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import rasters
from plumbline.operators import images
from plumbline.sources import backends, files, sinks


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_bytes(b"<p>\xff ok</p>")
    (tmp_path / "sub" / "b.HTM").write_text("no")
    (tmp_path / "sub" / "c.HTML").write_text("yes")
    got = files.read_html(spark, str(tmp_path)).collect()
    assert len(got) == 2 and any("\ufffd ok" in r["text"] for r in got)
    assert {r["name"] for r in files.list_assets(spark, str(tmp_path)).collect()} == {"a.html", "b.HTM", "c.HTML"}
    assert {len(r["sha256"]) for r in files.file_hashes(spark, str(tmp_path)).collect()} == {64}


def test_documents(spark, tmp_path):
    doc = {"schema_version": 1, "title": "x", "units": [{"id": "b1", "page": 1, "kind": "prose", "source": "s"}], "context": [{"text": "t", "evidence_ids": ["b1"]}], "glossary": []}
    (tmp_path / "d.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(doc).encode())
    tables = files.document_tables(files.read_json(spark, str(tmp_path)))
    assert tables["units"].first()["id"] == "b1" and tables["facts"].count() == 1 and tables["terms"].count() == 0


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"a": {"status": "OK", "inv": {"decodable": 2}}, "b": {"status": "OK", "inv": {"decodable": 9}}, "c": {"status": "BAD", "inv": {"decodable": 5}}, "d": {"status": "OK", "inv": {"decodable": 0}}}))
    assert [r["key"] for r in files.registry(spark, str(tmp_path)).collect()] == ["b", "a"]
    assert [r["key"] for r in files.registry(spark, str(tmp_path), ["a", "c"]).collect()] == ["a"]


def test_pdf_tables(spark):
    blocks = spark.createDataFrame([("d", 1, 320.0, 9.0, 1.0, 1.0, "Figure 2. b"), ("d", 1, 10.0, 50.0, 1.0, 1.0, "Fig. 1: a\nmore"), ("d", 1, 10.0, 5.0, 1.0, 1.0, "see Fig. 9."), ("d", 2, 10.0, 5.0, 1.0, 1.0, "Table 3 x")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted((r["num"], r["col"]) for r in files.captions(blocks).collect()) == [(1, "L"), (2, "R")]
    words = spark.createDataFrame([("d", 1, 50.0, 1.0, 1.0, 1.0, "(4)", 100.0), ("d", 1, 10.0, 1.0, 1.0, 1.0, "(5)", 100.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, width double")
    assert {(r["kind"], r["num"]) for r in files.anchors(words, blocks).collect()} == {("eq", 4), ("fig", 1), ("fig", 2), ("tab", 3)}


def test_positioned_lines(spark):
    lines = spark.createDataFrame([("d", 1.25, 2.0, 3.0, 4.0, "See FIG one"), ("d", 1.0, 2.0, 3.0, 4.0, "none")], "doc_id string, x0 double, y0 double, x1 double, y1 double, text string")
    assert [(r["x0"], r["text"]) for r in files.lines_with(lines, ["fig"]).collect()] == [(1.2, "See FIG one")]
    read = spark.createDataFrame([("d", 9.0, 31.0, "c", 0.5), ("d", 90.0, 29.0, "b", 1.0), ("d", 5.0, 4.0, "a", 0.994)], "doc_id string, x double, y double, text string, score double")
    assert files.read_order(read, ["doc_id"]).first()["text"] == "a (0.99) | b (1.00) | c (0.50)"


def test_extraction_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"12345")
    (tmp_path / "in" / "b").write_bytes(b"67")
    assert files.total_bytes(spark, str(tmp_path / "in")) == 7
    tables = {"text": spark.createDataFrame([("d", "# x"), ("e", "y")], "doc_id string, markdown string"), "pages": spark.createDataFrame([("d", 1)], "doc_id string, page int")}
    sinks.write_tables(tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "text")).count() == 2 and (tmp_path / "out" / "pages" / "doc_id=d").is_dir()


def test_probe(spark):
    df = spark.createDataFrame([(1, "overlaps:2 ## images:loaded:3")], "id long, raw string")
    stats = files.probe_stats(df, "raw").first()["stats"]
    assert stats == {"overlaps": "2", "images": "loaded:3"}
    counts = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 1, 0, 0, 3)], "id long, overlaps long, broken long, nonEmbedded long, leftoverDollar long")
    assert {r["id"]: r["problems"] for r in files.judge(counts, "id").collect()} == {1: "", 2: "overlaps,leftoverDollar"}


def test_patches_are_idempotent(spark):
    df = spark.createDataFrame([(1, "<style>a</style><style>b</style><body>x</body>"), (2, "plain")], "id long, html string")
    once = sinks.patch_wide(sinks.patch_overlap(df, "html"), "html")
    twice = sinks.patch_wide(sinks.patch_overlap(once, "html"), "html")
    a, b = ({r["id"]: r["html"] for r in x.collect()} for x in (once, twice))
    assert a == b and a[1].count("plumbline:tags") == 1 and a[1].index("plumbline:tags") < a[1].index("<style>b") and a[2] == "plain"


def test_self_contained(spark):
    md = "a ![x](img/a.png) b ![y](http://h/z.png) c ![z](img/none.png)\n"
    df = spark.createDataFrame([(1, md), (2, "no image"), (3, "")], "id long, md string")
    assets = spark.createDataFrame([(1, "img/a.png", bytearray(b"png!"))], "id long, name string, content binary")
    got = {r["id"]: r for r in sinks.self_contained(df, assets, "id", "md").collect()}
    assert got[1]["md"] == md.replace("img/a.png", "data:image/png;base64," + base64.b64encode(b"png!").decode()) and got[1]["missing"] == "img/none.png"
    assert got[2]["md"] == "no image" and got[3]["md"] == ""


def test_overwrite_plan_and_export(spark):
    html = spark.createDataFrame([("abcd1234", "/o/p.html"), ("short", "/o/q.html")], "key string, path string")
    t = spark.createDataFrame([("ABCD1234", "/s", "x.HTML"), ("ABCD1234", "/s", "y.pdf")], "key string, dir string, name string")
    assert [tuple(r) for r in sinks.overwrite_plan(html, t).collect()] == [("ABCD1234", "/o/p.html", "/s/x.HTML", "overwrite")]
    assert sinks.overwrite_plan(html, t.filter("name = 'y.pdf'")).first()["action"] == "copy"
    states = spark.createDataFrame([("a", "text_reviewed"), ("b", "draft")], "doc_id string, phase string")
    tr = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 1, "x")], "doc_id string, ord long, text string")
    assert [tuple(r) for r in sinks.export_tables(states, tr).collect()] == [("a", "one\n\ntwo\n")]


def test_report_and_control_file(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([("d", "r")], "doc_id string, rule string"), str(tmp_path / "rep"), by="doc_id")
    assert spark.read.json(str(tmp_path / "rep")).count() == 1
    sinks.write_control_file(str(tmp_path / "x" / "c.json"), b"{}")
    assert (tmp_path / "x" / "c.json").read_bytes() == b"{}" and len(list((tmp_path / "x").iterdir())) == 1


def test_backends(spark):
    class Upper:
        name = "upper"

        def process(self, content, **options):
            if bytes(content) == b"bad":
                raise ValueError("no")
            return [{"markdown": bytes(content).decode().upper()}]

    Upper.__module__ = "__main__"  # so that it is pickled by value
    df = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad"))], "id string, content binary")
    got = {r["id"]: (r["status"], r["markdown"]) for r in backends.run_backend(df, "id", "content", Upper(), *backends.PDF_TEXT).collect()}
    assert got == {"a": ("ok", "X"), "b": ("error", None)}
    off = backends.run_backend(df, "id", "content", backends.Unavailable("pdf"), *backends.PDF_TEXT)
    assert {r["status"] for r in off.collect()} == {"unavailable"}


def test_images_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, '<img src="data:image/png;base64,@@@@" alt="">'), (4, "<img alt='x'>")], "id long, html string")
    got = images.extract(df, "id", "html")
    assert {r["id"] for r in got.collect()} == {3, 4} and [r["id"] for r in images.broken(got, "id").collect()] == [3]


def test_rasters():
    page = np.full((60, 80), 255, np.uint8)
    page[10:30, 20:50] = 0
    page[40:44, 5:9] = 0
    found = rasters.components(rasters.ink(page))
    assert [(c["x"], c["y"], c["w"], c["h"], c["area"]) for c in found] == [(20, 10, 30, 20, 600), (5, 40, 4, 4, 16)]
    assert len(rasters.solid_blobs(rasters.ink(page))) == 1
    same = rasters.pair_metrics(page, page)
    assert same["iou"] == 1 and same["missing"] == 0 and same["hash_distance"] == 0
    gone = page.copy()
    gone[40:44, 5:9] = 255
    assert rasters.pair_metrics(gone, page)["missing"] > 0 == rasters.pair_metrics(gone, page)["extra"]
    assert rasters.ghost_metrics(page, gone)["unexplained"] > 0 == rasters.ghost_metrics(page, gone)["vanished"]
    hit = rasters.match(page, page[8:35, 15:55])
    assert (hit["x"], hit["y"]) == (15, 8) and hit["ccoeff"] > 0.99 and hit["sqdiff"] < 1e-6
    assert rasters.image_type(page) == "lineart" and rasters.image_type(np.full((9, 9), 128, np.uint8)) == "halftone"
    diagonal = np.eye(12, dtype=bool)
    assert len(rasters.components(diagonal)) == 1 and len(rasters.scale_ladder()) > 46
