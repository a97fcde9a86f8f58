"""Registered queries: each is a Spark job over the given tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkwarden.plans import domain

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; ``sql`` is the query to compare with, if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


class Inputs:
    """Derived tables of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in domain.TABLES:
            return domain.table(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def metadata_text() -> dict[str, Column]:
    """The metadata as one text, for ``also`` of the audit: ``flat`` takes it over instead of reading each finding's map."""
    pairs = F.transform(
        F.sort_array(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    )
    return {"metadata_text": F.coalesce(F.array_join(pairs, ";"), F.lit(""))}


def flat(findings: DataFrame) -> DataFrame:
    """Findings without nested columns."""
    text = F.col("metadata_text") if "metadata_text" in findings.columns else metadata_text()["metadata_text"]
    return findings.select(
        "repo", "verifier_id", "rule_id", "severity", "message", "location.path", "location.start_line", "location.start_col",
        "location.end_line", "location.end_col", "location.snippet", "provenance_score",
        text.alias("metadata"),
    )
