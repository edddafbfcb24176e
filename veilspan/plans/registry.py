"""Named queries over the driver tables, each with an independent SQL formulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


class Tables:
    """``t.documents`` reads ``<folder>/documents.parquet``."""

    #: How a local run lays out the scans of tables with long rows; as they are unless it says otherwise.
    layout: Callable[[DataFrame], DataFrame] = staticmethod(lambda rows: rows)

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        rows = table(self._spark, self._folder, name)
        return self.layout(rows) if name in ("documents", "orders", "pages") else rows


def load_all() -> None:
    from . import (detection_queries, external_queries, masking_queries, overlap_queries, segment_queries,  # noqa: F401
                   signal_queries, source_queries, stream_queries, summary_queries, text_queries, token_queries,
                   transcript_queries)
