"""Verdict tables to one status: 0 passed, 1 failed, 2 needs review or input missing. Only the gate may raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODES = {"ok": 0, "reviewed": 0, "hit": 0, "fail": 1, "error": 1, "corrupt": 1, "needs_review": 2, "miss": 2, "unavailable": 2}


def gate(df: DataFrame, status_col: str = "status") -> DataFrame:
    """code and n of the worst status; an unknown status counts as failed, and no rows as missing input."""
    code = F.lit(1)
    for name, value in CODES.items():
        code = F.when(F.col(status_col) == name, value).otherwise(code)
    out = df.agg(F.max(code).alias("worst"), F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("worst", F.lit(2)).cast("long").alias("code"), "n")


def require(df: DataFrame, status_col: str = "status") -> None:
    code = gate(df, status_col).first()["code"]
    if code:
        raise RuntimeError(f"gate closed with code {code}")
