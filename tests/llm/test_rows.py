"""Quality rules, decontamination, URL filter, mixing and sharding against plain Python."""

from collections import Counter

import pytest

from plumbline.llm import decontam, mixing, quality, sharding, urls

from . import brute


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def test_quality(documents, cluttered, empty):
    rules = quality.QualityRules()
    rows = [*enumerate(brute.passages(8)), (None, "a b"), (4, None), (1, "x\nx\n x\n\nx")]
    got = quality.quality(cluttered(documents(rows)), rules).drop("base_failed", "kept").collect()
    assert order(map(tuple, got)) == order((i, *brute.quality(t, list(rules.ngram_limits), rules.window)) for i, t in rows)
    assert quality.quality(empty).collect() == []


def test_quality_verdicts(documents):
    varied = " ".join(f"w{k}" for k in range(60))
    rows = [(1, varied), (2, "few words"), (3, None), (4, "one two three four five six seven eight " * 5), (5, varied + "\n" + "\n".join(["again and again"] * 40)), (6, varied + " #$ " * 60), (7, "alpha beta gamma delta eps " * 2 + varied)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality(documents(rows)).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (True, False), 6: (True, False), 7: (False, True)}


def test_quality_of_very_long_texts(documents):
    text = " ".join(f"w{k}" for k in range(80_000)) + " again" * 10
    got = quality.quality(documents([(1, text), (2, "a b " * 150_000)])).orderBy("doc_id").collect()
    assert (got[0]["n_words"], got[0]["n_repeat_words"], got[0]["kept"]) == (80_010, 10, True)
    assert got[1]["n_repeat_words"] == got[1]["n_words"] == 300_000 and got[1]["base_failed"]


def test_quality_survives_collisions(monkeypatch):
    import numpy as np

    monkeypatch.setattr(quality, "window_hash", lambda p, n: np.zeros(max(0, len(p) - n), np.uint64))
    rules = quality.QualityRules()
    for text in brute.passages(9, 30):
        got = quality.measure((text or "").encode(), rules)
        assert (*got[:7], *got[7]) == brute.quality(text, list(rules.ngram_limits), rules.window)


@pytest.mark.parametrize("bits", [decontam.BITS, 1 << 15])
def test_decontamination(spark, documents, cluttered, empty, bits):
    texts = brute.passages(10)
    items = [(k, " ".join((t or "").split()[:n])) for k, (t, n) in enumerate(zip(texts[20:32], (3, 13, 14, 30, 60, 1, 0, 13, 20, 9, 40, 13)))] + [(50, None), (51, "THE  ab!"), (52, "the ab"), (None, "w1 w2")]
    rows = [*enumerate(texts), (None, "the ab"), (2, None), (70, "w1 w2 the ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(cluttered(documents(rows)), cluttered(bench), bits=bits).collect()
    want = []
    for i, t in rows:
        want.append((i, *brute.decontaminated([(0, t)], items, 13)[0]))
    assert order(map(tuple, got)) == order(want) and any(r[5] for r in want)
    assert decontam.decontaminate(empty, bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["n_hit"] for r in decontam.decontaminate(documents(rows), none).collect())


def test_decontamination_of_long_and_repeated_texts(spark, documents):
    """One passage in a third of the rows, in a text of many words, and in copies."""
    passage = " ".join(f"p{k}" for k in range(20))
    long = " ".join(f"w{k}" for k in range(50_000))
    rows = [(k, f"start {k} {passage} end {k}") for k in range(200)] + [(500, long + " " + passage), (501, long), (502, passage), (503, passage), (504, passage[3:])]
    bench = spark.createDataFrame([(1, passage), (2, passage), (3, "p0")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.decontaminate(documents(rows), bench, bits=1 << 15).collect()}
    assert all(got[k] == (20, 3) for k in [*range(200), 500, 502, 503]) and got[501] == (0, 0) and got[504] == (19, 2)


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7", "https://example.com/en/7?q", "http://example.com/en/", "http://xexample.net/de/8", "http://b.example.net/de/8#x", "http://example.net/de/9", "http://org/es/", "http://a.org/es", "http://net", "http://com/en/x?y/z", "http://host:80/p", "http://a..com/en/1", "x://y://z/en", "http://example.com", "http://EXAMPLE.com/EN/7", "http://é.com/en/é"]
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@pytest.mark.parametrize("block", [256, 4, 1])
def test_urls(spark, cluttered, monkeypatch, block):
    monkeypatch.setattr(urls, "BLOCK", block)
    rows = [(k, u) for k, u in enumerate(URLS * 2)] + [(None, URLS[5])]
    pages = cluttered(spark.createDataFrame(rows, "page_id long, url string"))
    rules = RULES + [("allow", "com/en/1"), ("block", "com/"), ("allow", "a.example.com/")]
    got = urls.filter_urls(pages, urls.rule_table(spark, rules)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert order(map(tuple, got)) == order((k, *brute.url_verdict(u, rules, "allow")) for k, u in rows)


def test_nested_rules_over_many_blocks(spark, monkeypatch):
    """Deep nests of rules whose stacks are carried from block to block, against plain Python."""
    import random

    monkeypatch.setattr(urls, "BLOCK", 8)
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "a.net", "xcom"]
    path = lambda: "".join(rng.choices("ab", k=rng.randint(0, 7)))
    rules = list({f"{rng.choice(hosts)}/{path()}": rng.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(v, r) for r, v in rules]
    rows = [(k, f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{path()}") for k in range(400)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark, rules))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()}
    for k, u in rows:
        want = brute.url_verdict(u, rules, "allow")
        fits = [r for v, r in rules if want[2] and len(r) == len(want[2]) and brute.url_verdict(u, [(v, r)], "allow")[2]]
        assert got[k][:2] == want[:2]
        assert got[k][2:] == want[2:] if len(fits) < 2 else got[k][2] == max(fits, key=lambda r: len(r.partition("/")[0]))


def test_urls_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "old")], "page_id long, url string, verdict string")
    none = urls.rule_table(spark, RULES).limit(0)
    assert [r["verdict"] for r in urls.filter_urls(pages, none, "block").collect()] == ["block"]
    assert urls.filter_urls(pages.limit(0), urls.rule_table(spark, RULES)).collect() == []
    both = urls.rule_table(spark, [("allow", "a.b/c"), ("block", "a.b/c")])
    assert [(r["rule"], r["verdict"]) for r in urls.filter_urls(pages, both).collect()] == [("a.b/c", "block")]
    assert urls.filter_urls(pages, both).columns == ["page_id", "url", "host", "path", "rule", "verdict"]


def test_mixing(documents, cluttered, empty):
    rows = [(k, "t", None, f"s{k % 7 if k % 3 else 0}") for k in range(400)] + [(900, None, None, None), (901, "", None, "rare"), (None, "n", None, "s1"), (5, "again", None, "s5")]
    weights = {"s0": 3.0, "rare": 40.0, "s2": 0.0}
    got = mixing.mix_sources(cluttered(documents(rows)), weights, seed=3)
    assert got.columns == [*cluttered(documents(rows)).columns, "copy"]
    seen = Counter((r["doc_id"], r["source"]) for r in got.collect())
    want = Counter()
    for d, n in brute.mixed([(r[0], r[3]) for r in rows], weights, 3, [r[1] for r in rows]).items():
        want[d] += n
    assert seen == Counter({d: n for d, n in want.items() if n}) and max(seen.values()) > 16
    assert not any(s == "s2" for _, s in seen)
    assert mixing.mix_sources(empty).collect() == []
    again = mixing.mix_sources(documents(rows).repartition(1), weights, seed=3)
    assert Counter((r["doc_id"], r["source"]) for r in again.collect()) == seen


def test_rows_without_ids_draw_apart(documents):
    rows = [(None, f"text {k}", None, f"s{k % 2}") for k in range(400)]
    got = Counter(r["text"] for r in mixing.mix_sources(documents(rows), {"s0": 2.0}, seed=17).collect())
    assert 100 < len(got) < 400 and 330 < sum(got.values()) < 470


def test_mixing_meets_weights(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "'t' text", "case when id % 10 < 8 then 'big' else 'small' end source")
    n = Counter(r["source"] for r in mixing.mix_sources(docs, {"small": 3.0, "big": 1.0}, target_rows=8000).collect())
    assert abs(n["small"] - 6000) < 4 * 6000**0.5 and abs(n["big"] - 2000) < 4 * 2000**0.5


def test_mixing_has_no_python(spark, sf):
    from plumbline.llm import queries

    for name in ("op5_mix_sources", "op3_url_filter", "op9_sharding"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_sharding(documents, cluttered, empty):
    rows = [(k, "t") for k in range(3000)] + [(None, "n"), (7, "same id")]
    got = sharding.assign_shards(cluttered(documents(rows)), 10, 1009)
    assert got.columns == [*cluttered(documents(rows)).columns, "shard"]
    of = {}
    for r in got.collect():
        assert of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    n = Counter(of.values())
    assert set(n) == set(range(10)) and max(n.values()) < 1.4 * min(n.values())
    assert sharding.assign_shards(empty).collect() == []


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    full, less = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    n = Counter(full)
    assert max(n.values()) - min(n.values()) <= 1
    assert sum(a != b for a, b in zip(full, less) if a != 6) < 0.25 * 1009
    for shards, slots in (([], 7), (names, 1008), (names, 5), (names, 1_000_033)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_write_shards(documents, tmp_path, spark):
    sharding.write_shards(documents([(k, "t") for k in range(50)]), str(tmp_path / "out"), n_shards=4, slots=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
