import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (id, text) or (id, text, lang, source) rows, over several partitions."""

    def make(rows, schema=DOCUMENTS):
        full = [(*r, *(None, None)[len(r) - 2 :], len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def cluttered():
    """The table with further columns whose names operators use inside, or that need quoting."""

    def add(df):
        extra = ["id", "row", "digest", "n", "sub", "chunk", "bands", "rep", "u", "v", "node", "component", "hit", "parent", "salt", "mix_key", "mix_n", "mix_copy", "shard_slot", "key_slot", "gone_id", "a.b", "c`d", "item", "word", "size"]
        return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)], F.lit(None).cast("void").cast("int").alias("nothing"))

    return add


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCUMENTS))
