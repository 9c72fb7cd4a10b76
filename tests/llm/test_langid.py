"""Language identification: held-out accuracy, and scores recomputed plainly."""

import math

import pytest

from plumbline.llm import langid
from plumbline.llm.common import table

from . import brute


def plain_scores(model, text):
    words = brute.LETTERS.findall(text.lower())
    total = [0.0] * len(model.langs)
    for w in words:
        if w in model.words:
            row = model.word_logs[model.words[w]]
            add = [float(x) for x in row]
        else:
            padded, found = f"^{w}$", []
            for k in range(len(padded)):
                for n in (4, 3, 2, 1):
                    g = padded[k : k + n]
                    if len(g) == n and g in model.grams:
                        found.append(model.gram_logs[model.grams[g]])
                        break
            add = [sum(float(f[j]) for f in found) / len(found) if found else 0.0 for j in range(len(model.langs))]
        total = [a + b for a, b in zip(total, add)]
    z = [t * min(len(words), langid.EVIDENCE) / len(words) for t in total]
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(z)), key=z.__getitem__)
    return model.langs[best], e[best] / sum(e)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in langid.identify(docs, langid.train(docs)).collect() if brute.held_out(r["doc_id"])]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows)
    assert len(rows) > 150 and right >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scores(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.train(docs)
    scorer = langid.Scorer(model)
    for text in [r["text"] for r in docs.limit(40).collect()] + ["unseenword zzzqq", "étrange straße", "日本 語", "a"]:
        lang, score = scorer.predict(text)
        want = plain_scores(model, text)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-9)


def test_memo_limit(monkeypatch, spark, sf):
    model = langid.train(table(spark, sf, "documents"))
    want = langid.Scorer(model).predict("qa qb qc qd qe qf")
    monkeypatch.setattr(langid, "MEMO", 2)
    small = langid.Scorer(model)
    for _ in range(3):
        assert small.predict("qa qb qc qd qe qf") == pytest.approx(want)


def test_labels_are_only_for_learning(documents):
    rows = [(k, "der hund und die katze" if k % 2 else "the dog and the cat", "de" if k % 2 else "en", "s") for k in range(40)]
    model = langid.train(documents(rows))
    swapped = [(i, t, "xx", "other") for i, t, _, _ in rows] + [(99, "die katze", None, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(documents(swapped), model).collect()}
    assert got == {**{k: "de" if k % 2 else "en" for k in range(40)}, 99: "de"}
    learnt_from = [r for r in rows if not brute.held_out(r[0])]
    only = langid.train(documents(learnt_from))
    assert only.words.keys() == model.words.keys() and (only.word_logs == model.word_logs).all()


def test_edges(documents, cluttered, empty):
    rows = [(1, None, "en", None), (2, "", "en", None), (3, "123 _ !", "en", None), (None, "the cat", "en", None), (4, "the cat", "en", None), (4, "the cat", "en", None), (6, "x", None, None)]
    df = cluttered(documents(rows))
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in langid.identify(df, langid.train(df)).collect())
    assert got == [(0, "en", 1.0), (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "en", 1.0), (4, "en", 1.0), (6, "en", 1.0)]
    assert langid.identify(empty, langid.train(empty)).collect() == []
    unlabelled = documents([(1, "some text")])
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(unlabelled, langid.train(unlabelled)).collect()] == [("und", 0.0)]


def test_small_sample_keeps_every_language(documents):
    """A language far below the others, and one with a single long document, stay; all words of a sampled text are learned."""
    rows = [(k, f"word{k} the", "en", None) for k in range(300)] + [(1000 + k, f"mot{k} le", "fr", None) for k in range(3)]
    rows += [(2001, " ".join(f"wort{k}" for k in range(500)), "de", None)]
    rows = [r for r in rows if not brute.held_out(r[0])]
    model = langid.train(documents(rows), train_docs=50, train_chars=300)
    assert model.langs == ["de", "en", "fr"] and "the" in model.words and "le" in model.words
    for k in range(500):
        assert f"wort{''.join(c for c in str(k) if c.isalpha())}" in model.words
    assert sum(w.startswith("word") for w in model.words) <= 100


def test_training_like_plain_counts(spark, sf, documents):
    """Counts, smoothing and n-grams from whole documents, recomputed in plain Python."""
    rows = [(r["doc_id"], r["text"], r["lang"], None) for r in table(spark, sf, "documents").limit(60).collect()]
    model = langid.train(documents(rows))
    words = {}
    for i, text, lang, _ in rows:
        if text is not None and lang is not None and not brute.held_out(i):
            for w in "".join(c if c.isalpha() else " " for c in text.lower()).split(" "):
                if w:
                    words.setdefault(lang, {}).setdefault(w, 0)
                    words[lang][w] += 1
    assert model.langs == sorted(words)

    def check(index, logs, counts):
        assert set(index) >= {t for c in counts.values() for t in c}
        vocabulary = len({t for c in counts.values() for t in c})
        for k, lang in enumerate(model.langs):
            total = sum(counts[lang].values()) + 0.5 * vocabulary
            for t in {t for c in counts.values() for t in c}:
                assert logs[index[t], k] == pytest.approx(math.log((counts[lang].get(t, 0) + 0.5) / total))

    check(model.words, model.word_logs, words)
    for size in (1, 2, 3, 4):
        grams = {lang: {} for lang in words}
        for lang, own in words.items():
            for w, n in own.items():
                for k in range(len(w) + 3 - size):
                    g = f"^{w}$"[k : k + size]
                    grams[lang][g] = grams[lang].get(g, 0) + n
        check(model.grams, model.gram_logs, grams)


def test_numbers_are_no_letters(documents):
    rows = [(1, "\u00b2 \u00bd \u2460 12 \u2167", "en", None), (2, "the\u00b2cat", "en", None), (4, "le chat", "fr", None), (6, "the cat", "en", None)]
    assert langid.words_of("\u00b2 \u00bd \u2460 12") == [] and langid.words_of("The\u00b2Cat_x") == ["the", "cat", "x"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(documents(rows), langid.train(documents(rows))).collect()}
    assert got[1] == "und" and got[2] == "en"


def test_very_long_text(documents):
    rows = [(1, "the cat sat " * 200_000, "en", None), (2, "le chat dort", "fr", None), (4, "the dog", "en", None), (6, "le chien", "fr", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(documents(rows), langid.train(documents(rows))).collect()}
    assert got[1] == "en"
