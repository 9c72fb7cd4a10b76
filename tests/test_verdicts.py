"""Verdicts over all blocking rules."""

from plumbline.functions import scanner
from plumbline.operators import images, leaks
from plumbline.plans import catalog

GIF = "data:image/gif;base64,R0lGODlhAQABAAAAACw="
CLEAN = "<p>text</p>"
#: page body -> blocking findings
PAGES = {
    CLEAN: 0,
    "": 0,
    f'<img src="{GIF}" alt="a"><img src="{GIF}" alt="a"><img alt="none">': 0,
    f'<img src="{GIF}" alt="a"><img src="{GIF}" alt="b">': 1,
    '<img src="x.png"><img src="http://h/y.png">': 2,
    '<img src="data:image/png;base64,!!!!">': 1,
    '<img src="data:image/png">': 1,
    '<script src="https://h/a.js"></script><link href="//h/b.css">': 2,
    '<script src="a.js"></script><link href="b.css">': 0,
    "<style>p{background:url('https://h/a.png')}</style>": 1,
    '<span class="katex-error" title="x">y</span>': 1,
    '<script>"<span class=\\"katex-error\\""; \'<span class="katex-error"\'</script><style><span class="katex-error"</style>': 0,
    "<p>left ~~l~~ real</p>": 1,
    "<p>译文_摘要_完成</p>": 1,
    "<p>见图 6 所示</p>": 0,
}


def page_verdicts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    found = scanner.page_findings(pages, "page_id", "html").selectExpr("page_id as subject_id", "severity")
    for more in (leaks.reference_findings(pages, "page_id", "html"), images.findings(images.extract(pages, "page_id", "html"), "page_id")):
        found = found.unionByName(more.select("subject_id", "severity"))
    return {r["page_id"]: (r["n_blocking"], r["ok"]) for r in leaks.verdicts(pages, found, "page_id").collect()}


def test_page_verdicts(spark):
    got = page_verdicts(spark, [*((k, f"<html><body>{html}</body></html>") for k, html in enumerate(PAGES)), (99, None)])
    assert got == {**{k: (n, not n) for k, n in enumerate(PAGES.values())}, 99: (0, True)}


def test_page_verdict_query(spark, sf):
    pages = {r["page_id"]: r for r in catalog.QUERIES["page_verdicts"](spark, sf).collect()}
    parts = {name: {r["page_id"] for r in catalog.QUERIES[name](spark, sf).collect()} for name in ("non_embedded_images", "broken_images", "dup_image_bytes", "html_leaks")}
    audited = {r["page_id"] for r in catalog.QUERIES["page_audit"](spark, sf).filter("severity = 'error'").collect()}
    bad = audited.union(*parts.values())
    assert pages.keys() >= bad and {k for k, r in pages.items() if not r["ok"]} == bad


def test_italic_blocks(spark, tmp_path):
    rows = [(1, "plain"), (2, "a _摘要_ b"), (3, "x_摘要_ b _索引词_y (_全局_) _∗_")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    text = {(r["subject_id"], r["ord"], r["match"]) for r in catalog.QUERIES["text_leaks"](spark, str(tmp_path)).filter("rule = 'md_italic'").collect()}
    assert text == {(2, 0, "摘要"), (3, 0, "全局"), (3, 1, "∗")}
    every = catalog.QUERIES["text_leaks"](spark, str(tmp_path)).groupBy("subject_id").count().collect()
    verdicts = {r["doc_id"]: r["n_blocking"] for r in catalog.QUERIES["leak_verdicts"](spark, str(tmp_path)).collect()}
    assert verdicts == {r["subject_id"]: r["count"] for r in every}
    bare = spark.createDataFrame(rows, "doc_id long, text string")
    alone = leaks.verdicts(bare, leaks.regex_findings(bare, "doc_id", "text", leaks.TEXT_RULES), "doc_id")
    assert {r["doc_id"]: r["ok"] for r in alone.collect()} == {1: True, 2: False, 3: False}
