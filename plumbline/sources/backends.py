"""Interfaces to what Spark cannot do itself: rendering, OCR, formula typesetting and browsers.

A backend is a picklable object; it runs inside mapInPandas, one instance a partition. Without one, every row comes out as
"unavailable", which the gate treats as not passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Backend(Protocol):
    name: str

    def process(self, content: bytes, **options) -> list[dict]:
        """The rows that one file or image gives."""


class Unavailable:
    """Stands in for a missing backend."""

    def __init__(self, name: str):
        self.name = name

    def process(self, content: bytes, **options) -> list[dict]:
        raise NotImplementedError(f"no backend for {self.name}")


def run_backend(df: DataFrame, id_col: str, content_col: str, backend: Backend, schema: str, columns: list[str], **options) -> DataFrame:
    """id, status (ok, unavailable or error), detail and the backend's columns; a failing row never fails the job."""
    kind = df.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, content in zip(b[id_col], b[content_col]):
                try:
                    rows += [{id_col: key, "status": "ok", "detail": None, **r} for r in backend.process(content, **options)]
                except NotImplementedError as e:
                    rows.append({id_col: key, "status": "unavailable", "detail": str(e)})
                except Exception as e:  # noqa: BLE001
                    rows.append({id_col: key, "status": "error", "detail": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(rows, columns=[id_col, "status", "detail", *columns], dtype=object)

    return df.select(id_col, content_col).mapInPandas(each, f"{id_col} {kind}, status string, detail string, {schema}")


PDF_TEXT = ("markdown string", ["markdown"])
PDF_PAGES = ("page int, w int, h int, png binary", ["page", "w", "h", "png"])
PDF_IMAGES = ("page int, xref int, w int, h int, png binary", ["page", "xref", "w", "h", "png"])
OCR_LINES = ("x double, y double, text string, score double", ["x", "y", "text", "score"])
FORMULA_RENDER = ("html string, problem string", ["html", "problem"])
DOM_PROBE = ("result string", ["result"])
RASTERS = ("w int, h int, gray binary", ["w", "h", "gray"])
