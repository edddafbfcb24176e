"""Correct, detect and mask a recognised text in one pass, with the errors of every document."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import no_spans
from ..functions.text import strip
from . import corrections, detect, masking


def process(df: DataFrame, text: str = "text", error: str | None = None, rules: dict[str, Any] | None = None,
            response: str | None = None, predictions: str | None = None) -> DataFrame:
    """Adds ``corrected_text``, ``spans``, ``masked_text``, ``records``, ``errors`` and ``success`` to ``df``.

    ``error`` names a column with the error of an earlier step, ``response`` one of stored
    corrections, ``predictions`` one of model output.  A row with an error, or without any text,
    keeps its place: its results are null, its spans and records empty, and its errors say why.
    Everything stays on the document's row, so nothing is shuffled.
    """
    earlier = F.lit(None).cast("string") if error is None else F.nullif(F.col(error), F.lit(""))
    body = strip(F.coalesce(F.col(text), F.lit("")))
    errors = F.filter(F.array(earlier, F.when(earlier.isNull() & (body == ""), "no text")), lambda e: e.isNotNull())
    marked = df.withColumn("errors", errors).withColumn("success", F.size("errors") == 0)
    fixed = corrections.correct(marked.withColumn("_text", F.when(F.col("success"), F.col(text)).otherwise("")), "_text", response)
    found = detect.detect_all(fixed.withColumn("_text", F.coalesce("corrected_text", F.lit(""))), "_text", "_spans", predictions)
    masked = masking.mask(found, "_text", "_spans", rules)
    ok = lambda c: F.when(F.col("success"), F.col(c))
    return masked.select(
        *df.columns, ok("corrected_text").alias("corrected_text"), F.coalesce(ok("_spans"), no_spans()).alias("spans"),
        ok("masked_text").alias("masked_text"), "records", "errors", "success")
