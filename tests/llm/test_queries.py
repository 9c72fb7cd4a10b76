"""Every query against its oracle, and the pipeline against plain Python."""

from collections import Counter

import pytest

import corpus_pipeline
from plumbline.llm import langid, queries, sharding
from plumbline.llm.common import table

from ..oracle import compare
from . import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    n, difference = compare(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)
    assert not difference and n


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() == table(spark, sf, "documents").count() and df.columns[0] == "doc_id"


def test_held_out_column(spark, sf):
    for r in queries.op8_language_id(spark, sf).collect():
        assert r["held_out"] == brute.held_out(r["doc_id"])


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents").collect()
    scorer = langid.Scorer(langid.train(table(spark, sf, "documents")))
    told = []
    for r in docs:
        lang, score, known = scorer.judge(r["text"]) if r["text"] is not None else ("und", 0.0, 0.0)
        if lang != "und" and score >= corpus_pipeline.MIN_LANG_SCORE and known >= corpus_pipeline.MIN_KNOWN:
            told.append(r)
    groups = brute.near_duplicates([(r["doc_id"], r["text"]) for r in told], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT)
    unique = [r for r in told if groups[r["doc_id"]][2]]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    judged = brute.decontaminated([(r["doc_id"], r["text"]) for r in unique], items, 13)
    clean = [r for r in unique if not judged[r["doc_id"]][1]]
    assert len(docs) >= len(told) > len(unique) > len(clean) > 0
    n = brute.mixed([(r["doc_id"], r["source"]) for r in clean], queries.SOURCE_WEIGHTS, queries.MIX_SEED)
    slots = sharding.lookup_table([f"shard-{k}" for k in range(queries.N_SHARDS)], queries.SHARD_SLOTS)
    want = Counter()
    for r in clean:
        place = slots[int(brute.hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:13], 16) % queries.SHARD_SLOTS]
        want[(*r, place)] = n[(r["doc_id"], r["source"])]
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*table(spark, sf, "documents").columns, "shard"]
    assert Counter(map(tuple, got.collect())) == Counter({r: k for r, k in want.items() if k})


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_take_any_table(spark, documents, cluttered, empty, sf):
    """Nulls, empty texts, repeats, shared ids and columns with clashing names: every stage gives what its docstring says."""
    cat = "the cat and the dog sat on the mat by the door"
    passage = table(spark, sf, "benchmark").first()["text"]
    rows = [(1, None, None, None), (None, cat, "en", "src0"), (2, "", "en", None), (3, cat, "en", "src0"), (3, cat, "en", "src0"), (3, "el gato y el perro", "es", "src1"), (4, "1 2 3", "en", "src1"), (5, "le chat noir " * 60 + passage, "fr", "src1")]
    full = cluttered(documents(rows))
    lang, near, clean, mix, shard = (lambda docs, f=f: f(spark, docs, sf) for _, f in corpus_pipeline.STAGES)
    assert rows_of(lang(full)) == Counter({(None, cat): 1, (3, cat): 2, (3, "el gato y el perro"): 1, (5, rows[7][1]): 1})
    assert rows_of(near(full)) == Counter({(1, None): 1, (2, ""): 1, (3, cat): 1, (3, "el gato y el perro"): 1, (4, "1 2 3"): 1, (5, rows[7][1]): 1})
    assert rows_of(clean(full)) == Counter({r[:2]: 2 if r[:2] == (3, cat) else 1 for r in rows if r[0] != 5})
    mixed = rows_of(mix(full))
    draw = brute.mixed([(r[0], r[3]) for r in rows], queries.SOURCE_WEIGHTS, queries.MIX_SEED, [r[1] for r in rows])
    assert mixed == Counter({k: n for k, n in Counter({r[:2]: draw[r[0], r[3]] * (2 if r[:2] == (3, cat) else 1) for r in rows}).items() if n})
    assert rows_of(shard(full)) == rows_of(full) and len({(r["doc_id"], r["shard"]) for r in shard(full).collect()}) == 6
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, full, sf)
        assert out.columns[: len(full.columns)] == full.columns and (name == "shard" or out.columns == full.columns)
        assert stage(spark, empty, sf).collect() == []


def test_near_dedup_of_nameless_rows(spark, documents, sf):
    text = "one two three four five six seven eight nine"
    rows = [(None, text), (None, text), (None, text + " ten"), (None, "another one altogether it is, by far")]
    kept = rows_of(corpus_pipeline.near_dedup(spark, documents(rows), sf))
    assert sum(kept.values()) == 2 and kept[None, rows[3][1]] == 1


def test_all_ten_are_registered():
    """The driver's entry passes over a package that cannot be imported; a broken one must not go unseen."""
    import __spark_entry__

    named = {name.split("_")[0] for name in __spark_entry__.queries() if name.startswith("op")}
    assert named == {f"op{n}" for n in range(1, 11)} and "pipeline" in __spark_entry__.queries()
