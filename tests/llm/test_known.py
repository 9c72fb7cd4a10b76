"""The pipeline's language stage rejects what no learned language knows."""

import random

import corpus_pipeline
from plumbline.llm import langid
from plumbline.llm.common import table

ITALIAN = "Il ragazzo andava ogni mattina alla scuola del paese con la sua bicicletta rossa e non sapeva ancora che quel giorno sarebbe stato diverso"
POLISH = "Każdego ranka chłopiec jechał do szkoły na swoim czerwonym rowerze i nie wiedział jeszcze że ten dzień będzie zupełnie inny"


def scrambled(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(40))


def test_foreign_and_random_texts_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = [ITALIAN, POLISH, *(scrambled(k) for k in range(8))]
    planted = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.language_id(spark, docs.unionByName(planted, allowMissingColumns=True), "")
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_known_share():
    model = langid.build([("de", "hund", 1), ("de", "katze", 5), ("en", "dog", 1), ("en", "hund", 9)])
    scorer = langid.Scorer(model)
    assert scorer.judge("katze hund katze xyz") == (*scorer.predict("katze hund katze xyz"), 5 / 6)
    assert scorer.judge("dog dog dog xyz")[2] == 5 / 6 and scorer.judge("dog katze dog dog")[2] == 0.5 and scorer.judge("")[2] == 0
    alone = langid.Scorer(langid.build([("de", "hund", 1), ("de", "katze", 1)]))
    assert alone.judge("hund katze")[2] == 1 and alone.judge("q w e r t z")[2] == 0.25
