"""Greedy contiguous packing of a document's units under a byte budget and a unit limit.

Where a unit's cost is its own, the packing is one fold over the ordered array of a document. Where it depends on what a
batch holds (neighbours, evidence), pack_exact lets the caller prepare a document once and then asks for the cost of spans of it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_additive(units: DataFrame, budget: int, max_units: int, cost_col: str = "cost") -> DataFrame:
    """doc_id, ord, batch_no (from 0) and fits (the unit alone is within the budget)."""
    rows = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col(cost_col).cast("long").alias("cost")))).alias("u"))
    empty = F.array().cast("array<struct<ord: bigint, batch_no: bigint, fits: boolean>>")

    def step(s, x):
        new = (s["n"] == 0) | (s["n"] + 1 > max_units) | (s["bytes"] + x["cost"] > budget)
        batch = s["batch"] + new.cast("long")
        item = F.struct(x["ord"].cast("long").alias("ord"), batch.alias("batch_no"), (x["cost"] <= budget).alias("fits"))
        return F.struct(F.when(new, F.lit(1)).otherwise(s["n"] + 1).cast("long").alias("n"), F.when(new, x["cost"]).otherwise(s["bytes"] + x["cost"]).alias("bytes"), batch.alias("batch"), F.concat(s["out"], F.array(item)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"), F.lit(-1).cast("long").alias("batch"), empty.alias("out"))
    return rows.select("doc_id", F.explode(F.aggregate("u", start, step, lambda s: s["out"])).alias("x")).select("doc_id", "x.ord", "x.batch_no", "x.fits")


def greedy(items: list, cost: Callable[[list], int], budget: int, max_units: int) -> list[list]:
    """Extend a batch while it stays within both limits; an item that alone exceeds the budget is an error, never cut."""
    batches: list[list] = []
    for item in items:
        if batches and len(batches[-1]) < max_units and cost([*batches[-1], item]) <= budget:
            batches[-1].append(item)
            continue
        if cost([item]) > budget:
            raise ValueError("a unit with its full context exceeds the budget")
        batches.append([item])
    return batches


def pack_exact(units: DataFrame, prepare: Callable[[list[dict]], Callable[[int, int], int]], budget: int, max_units: int) -> DataFrame:
    """Like pack_additive, where prepare(units of a document in order) gives the cost of its units first..last (both included).

    A document that cannot be packed is one row with error set.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ord").to_dict("records")
        cost = prepare(rows)
        try:
            batches = greedy(list(range(len(rows))), lambda b: cost(b[0], b[-1]), budget, max_units)
        except ValueError as e:
            return pd.DataFrame({"doc_id": [rows[0]["doc_id"]], "ord": [None], "batch_no": [None], "error": [str(e)]})
        out = [(rows[k]["doc_id"], rows[k]["ord"], n, None) for n, b in enumerate(batches) for k in b]
        return pd.DataFrame(out, columns=["doc_id", "ord", "batch_no", "error"])

    kind = units.schema["doc_id"].dataType.simpleString()
    return units.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, ord long, batch_no long, error string")


def with_neighbours(rows: list[dict]) -> Callable[[int, int], int]:
    """Bytes of a span with the unit before and the one after it, from running sums (size: the unit's own bytes)."""
    until = [0, *accumulate(r["size"] for r in rows)]
    return lambda first, last: until[min(len(rows), last + 2)] - until[max(0, first - 1)]
