import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import cache, gate, packing, regions, units

U = "doc_id string, ord long, id string, page int, kind string, source string"
TERM = "doc_id string, ord long, id string, source string, target string, sense string, unit_ids array<string>, status string, variants array<string>"


@pytest.fixture
def doc(spark):
    rows = [("a", 1, "b1", 1, "prose", "The policy cut 1,200 kg [[CITE:1]]."), ("a", 2, "b2", 1, "table", "A policy network."), ("a", 3, "b3", 2, "caption", "图 1")]
    return spark.createDataFrame(rows, U)


def tr(spark, *texts):
    return spark.createDataFrame([("a", k + 1, f"b{k + 1}", t) for k, t in enumerate(texts) if t is not None], "doc_id string, ord long, id string, text string")


GOOD = ("政策减少 1200 kg [[CITE:1]]。", "策略网络。", "图 1")


def codes(df):
    return {r["id"] for r in df.collect()}


def test_good_pair(spark, doc):
    assert codes(units.inspect(doc, tr(spark, *GOOD))) == set()


def test_errors(spark, doc):
    assert codes(units.inspect(doc, tr(spark, GOOD[0], None, GOOD[2]))) == {"b2:empty_translation", "document:alignment"}
    assert "b1:protected_tokens" in codes(units.inspect(doc, tr(spark, "政策 1200 kg [[CITE:2]]", *GOOD[1:])))
    assert codes(units.inspect(doc, tr(spark, GOOD[0].replace("1200", "1300"), *GOOD[1:]))) == {"b1:numbers"}


def test_scoped_terms(spark, doc):
    terms = spark.createDataFrame([("a", 1, "t1", "policy", "政策", "rule", ["b1"], "approved", []), ("a", 2, "t2", "Policy", "策略", "agent", ["b2"], "approved", ["方针"])], TERM)
    assert units.term_conflicts(terms).count() == 0
    assert codes(units.inspect(doc, tr(spark, *GOOD), terms)) == set()
    assert codes(units.inspect(doc, tr(spark, *GOOD[:1], "网络。", GOOD[2]), terms)) == {"b2:term-t2"}
    clash = terms.withColumn("unit_ids", F.array(F.lit("b1")))
    assert units.term_conflicts(clash).count() == 1


def test_only_candidates_can_be_waived(spark, doc):
    issues = units.inspect(doc, tr(spark, GOOD[0].replace("1200", "1300"), " ", GOOD[2]))
    waive = spark.createDataFrame([("a", "b1:numbers", "unit changed"), ("a", "b2:empty_translation", "fine")], "doc_id string, issue_id string, reason string")
    assert codes(units.open_issues(issues, waive)) == {"b2:empty_translation"}
    assert "b1:numbers" in codes(units.open_issues(issues, waive.withColumn("reason", F.lit(" "))))


def test_assess(spark, doc):
    full = doc.select("doc_id", "id", F.lit("passed").alias("verdict"), units.required_checks(F.col("kind")).alias("checks"), F.lit(0).cast("long").alias("n_findings"))
    none = spark.createDataFrame([], "doc_id string, issue_id string, reason string")
    good = tr(spark, *GOOD)
    heads = units.versions(doc, good).withColumn("reviewer", F.lit("reader"))

    def judged(review_units=full, reviews=heads, translation=good):
        r = units.assess(doc, translation, None, reviews, review_units, none).first()
        return r["status"], r["n_blockers"]

    assert judged() == ("reviewed", 0)
    assert judged(full.filter("id <> 'b2'"))[1] == 2
    assert judged(full.withColumn("checks", F.slice("checks", 1, 3)))[0] == "needs_review"
    assert judged(reviews=heads.filter("false")) == ("needs_review", 1)
    assert judged(reviews=heads.withColumn("reviewer", F.lit(" "))) == ("needs_review", 1)
    assert judged(translation=tr(spark, GOOD[0] + "!", *GOOD[1:])) == ("needs_review", 1)  # the review is of another text
    assert judged(review_units=full.filter("false"), reviews=heads.filter("false")) == ("needs_review", 1)


def test_spans_with_neighbours():
    cost = packing.with_neighbours([{"size": 2**k} for k in range(6)])
    for a in range(6):
        for b in range(a, 6):
            assert cost(a, b) == sum(2**k for k in range(max(0, a - 1), min(6, b + 2)))


def test_lists_are_measured(spark, monkeypatch):
    from plumbline.operators import markdown

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "none")], "id long, text string")
    wanted = spark.createDataFrame([(7, "beta"), (8, "gamma")], "key long, t string")
    assert [tuple(r) for r in markdown.missing_texts(docs, wanted, "id", "text", "key", "t").orderBy("id").collect()] == [(1, 1, "8"), (2, 2, "7,8")]
    monkeypatch.setattr(markdown, "MAX_REQUIRED", 5)
    with pytest.raises(ValueError):
        markdown.missing_texts(docs, wanted, "id", "text", "key", "t")
    monkeypatch.setattr(units, "MAX_TERMS", 1)
    with pytest.raises(ValueError):
        units.relevant_terms(docs, wanted)


def test_conflicts_fold_case(spark):
    cols = "doc_id string, ord long, id string, source string, target string, sense string, unit_ids array<string>, status string"
    rows = [("a", 1, "x", "Straße", "t1", "s", ["b1"], "approved"), ("a", 2, "y", "STRASSE", "t2", "s", ["b1"], "approved")]
    assert [(r["word"], r["a_id"], r["b_id"]) for r in units.term_conflicts(spark.createDataFrame(rows, cols)).collect()] == [("strasse", "x", "y")]


def test_unit_violations(spark):
    bad = spark.createDataFrame([("a", 1, "-x", 1, "prose", "s"), ("a", 2, "y", 0, "poem", " \u3000"), ("a", 3, "z", 1, "prose", "s"), ("a", 4, "z", 1, "prose", "s"), ("a", 5, None, None, None, None)], U)
    got = {(r["id"], r["rule"]) for r in units.unit_violations(bad).collect()}
    assert {("-x", "unit_id"), ("y", "kind"), ("y", "page"), ("y", "blank_source"), ("z", "duplicate_id"), (None, "unit_id")} <= got


def test_quotes_and_references(spark, doc):
    q = spark.createDataFrame([("a", "b1", "policy cut"), ("a", "b2", "absent"), ("a", "b9", "x")], "doc_id string, unit_id string, quote string")
    assert {r["unit_id"] for r in units.unquoted(q, doc).collect()} == {"b2", "b9"}
    assert [r["unit_id"] for r in units.dangling(q, doc).collect()] == ["b9"]


@pytest.mark.parametrize("text,want", [("²5 rose −3 ％ to 1,234.5", ["-3%", "1234.5"]), ("[[EQ:7]] v2.1 4e5", ["4e5"]), ("", [])])
def test_numbers(spark, text, want):
    assert spark.range(1).select(tx.numbers(F.lit(text)).alias("n")).first()["n"] == want


def test_term_presence_is_literal_and_whole_word(spark):
    rows = [("a.b here", "a.b", True), ("axb here", "a.b", False), ("控制policy", "policy", False), ("POLICY!", "policy", True), (r"x\Ey z", r"x\Ey", True)]
    got = spark.createDataFrame(rows, "t string, w string, want boolean").select(tx.term_present(F.col("t"), F.col("w")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_packing(spark):
    costs = [5, 5, 5, 20, 1, 1, 1, 1]
    df = spark.createDataFrame([("a", k, c) for k, c in enumerate(costs)], "doc_id string, ord long, cost long")
    rows = [tuple(r)[1:] for r in packing.pack_additive(df, 12, 3).orderBy("ord").collect()]
    assert rows == [(0, 0, True), (1, 0, True), (2, 1, True), (3, 2, False), (4, 3, True), (5, 3, True), (6, 3, True), (7, 4, True)]
    ok = df.filter("cost < 20")
    whole = lambda rows: lambda a, b: sum(r["cost"] for r in rows[a : b + 1])
    exact = {r["ord"]: r["batch_no"] for r in packing.pack_exact(ok, whole, 12, 3).collect()}
    assert exact == {r["ord"]: r["batch_no"] for r in packing.pack_additive(ok, 12, 3).collect()}
    assert packing.pack_exact(df, whole, 12, 3).first()["error"]


def test_cache(spark):
    log = spark.createDataFrame([("b1", 1, "s [[EQ:1]]", "t [[EQ:1]]", True), ("b1", 2, "s [[EQ:1]]", "t", True), ("b2", 1, "s", " ", False), ("b3", 1, "s", "t", False), ("b3", 2, "s2", "t2", True)], "block_id string, seq long, source string, translation string, validated boolean")
    put = cache.put(log)
    assert {(r["block_id"], r["seq"]): r["status"] for r in put.collect()} == {("b1", 1): "validated", ("b1", 2): "rejected", ("b2", 1): "needs_review", ("b3", 1): "needs_review", ("b3", 2): "validated"}
    now = cache.latest(put)
    wanted = spark.createDataFrame([("b1", "s [[EQ:1]]"), ("b2", "s"), ("b3", "s"), ("b4", "s")], "block_id string, source string").select("block_id", F.sha2("source", 256).alias("source_sha256"))
    assert {r["block_id"]: r["outcome"] for r in cache.probe(wanted, now).collect()} == {"b1": "hit", "b2": "miss", "b3": "miss", "b4": "miss"}
    tampered = now.withColumn("translation", F.concat("translation", F.lit("!")))
    assert cache.probe(wanted, tampered).filter("block_id = 'b1'").first()["outcome"] == "corrupt"
    inputs = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    assert [r["path"] for r in cache.changed_inputs(inputs, inputs.filter("path = 'p'")).collect()] == ["q"]
    profile = spark.createDataFrame([("c", {"model": "m", "formula_mode": " "})], "cache_id string, profile map<string,string>")
    assert cache.profile_violations(profile).count() == 5


def test_gate(spark):
    one = lambda *s: gate.gate(spark.createDataFrame([(x,) for x in s], "status string")).first()["code"]
    assert (one("ok", "reviewed"), one("ok", "fail"), one("ok", "unavailable"), one("odd"), one()) == (0, 1, 2, 1, 2)
    with pytest.raises(RuntimeError):
        gate.require(spark.createDataFrame([("fail",)], "status string"))


@pytest.mark.parametrize(
    "change,rank",
    [({}, 9), ({"missing": 0.05 / 2}, 9), ({"missing": 0.03}, 7), ({"extra": 0.03}, 7), ({"iou": 0.79}, 6), ({"iou": 0.59}, 4), ({"missing": 0.06}, 4), ({"extra": 0.06}, 4), ({"extra": 0.16}, 3), ({"iou": 0.34}, 3), ({"cc": 0.39}, 3), ({"cc": None}, 9)]
    + [({"ok": False, "iou": None}, 5), ({"dup": True, "ok": False}, 0), ({"mismatch": True}, 1), ({"unmatched": True, "ok": None}, 2), ({"img_type": "halftone", "missing": 0.2}, 7), ({"img_type": None, "missing": 0.2}, 7), ({"iou": None}, 9)],
)
def test_severity(spark, change, rank):
    row = {"id": 1, "dup": False, "mismatch": False, "unmatched": False, "ok": True, "iou": 0.8, "missing": 0.0, "extra": 0.0, "cc": 0.7, "img_type": "lineart"} | change
    schema = "id long, dup boolean, mismatch boolean, unmatched boolean, ok boolean, iou double, missing double, extra double, cc double, img_type string"
    assert regions.severity(spark.createDataFrame([tuple(row.values())], schema), "id").first()["rank"] == rank
