"""Stored answers of external services as columns of raw JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import (ANALYSIS_RESPONSE, ASR_RESPONSE, CORRECTION_RESPONSE, NER_RESPONSE, VERDICT_RESPONSE)


def unfenced(raw: Column) -> Column:
    """The JSON inside optional triple-backtick fences."""
    opened = strip(F.regexp_replace(strip(raw), r"(?i)\A```(json)?", ""))
    return strip(F.regexp_replace(opened, r"```\z", ""))


def parsed_or_raw(answers: DataFrame, raw: str, schema: str, out: str = "parsed", fences: bool = False) -> DataFrame:
    """``answers`` with the parsed answer, and what cannot be parsed kept as it is.

    Adds ``out`` (null for a bad answer), ``corrupt`` (the raw text of a bad answer, else null) and
    ``problem``: ``missing`` for null and blank answers, ``broken`` for text that is no JSON or does
    not fit ``schema``, else null.  The raw column is replaced by these.
    """
    body = unfenced(F.col(raw)) if fences else strip(F.col(raw))
    wide = f"struct<{schema.strip()[len('struct<'):-1]},_corrupt:string>"
    read = answers.withColumn("_read", F.from_json(body, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    problem = F.when(F.coalesce(body, F.lit("")) == "", "missing").when(F.col("_read").isNull() | F.col("_read._corrupt").isNotNull(), "broken")
    marked = read.withColumn("problem", problem)
    return marked.withColumns({
        out: F.when(F.col("problem").isNull(), F.col("_read").dropFields("_corrupt")),
        "corrupt": F.when(F.col("problem").isNotNull(), F.col(raw))}).drop("_read", *([raw] if raw != out else []))


def quarantined(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of ``parsed_or_raw``; together they are all rows."""
    good = answers.where("problem IS NULL").drop("corrupt", "problem")
    return good, answers.where("problem IS NOT NULL")


def parse_ner(raw: Column) -> Column:
    return F.from_json(raw, NER_RESPONSE)


def parse_asr(raw: Column) -> Column:
    """``struct<success,text,error>``: first non-empty of three text fields, or the error message."""
    r = F.from_json(raw, ASR_RESPONSE)
    body = r["return_object"]

    def filled(field: str) -> Column:
        return F.nullif(body[field], F.lit(""))

    ok = F.coalesce(r["result"], F.lit(-1)) == 0
    text = F.coalesce(filled("recognized"), filled("result"), filled("text"), F.lit(""))
    code = F.coalesce(r["result"].cast("string"), F.lit("None"))
    reason = F.when(F.coalesce(r["reason"], F.lit("")) != "", F.concat(F.lit(" - Reason: "), r["reason"])).otherwise("")
    return F.struct(ok.alias("success"), F.when(ok, text).otherwise("").alias("text"),
                    F.when(~ok, F.concat(F.lit("API Error Code: "), code, reason)).alias("error"))


def parse_verdicts(raw: Column) -> Column:
    return F.from_json(unfenced(raw), VERDICT_RESPONSE)


def parse_correction(raw: Column) -> Column:
    return F.from_json(unfenced(raw), CORRECTION_RESPONSE)


def parse_analysis(raw: Column) -> Column:
    return F.from_json(unfenced(raw), ANALYSIS_RESPONSE)
