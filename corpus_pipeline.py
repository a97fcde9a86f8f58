"""From raw documents to packed training sequences: five stages, each by one operator of ``sparkwarden.llm``.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``. Null and empty texts go in the first stage, as texts in no known language; repeated rows are near
duplicates of each other; an empty table passes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkwarden.llm import language, packing, queries, repeats, setsketch, toxicity
from sparkwarden.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _row(docs: DataFrame) -> Column:
    """Equal for rows of equal id and text only, so that decisions reach rows with repeated and null ids."""
    t = F.coalesce("text", F.lit(""))
    return F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.xxhash64(t), F.hash(t))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language with a posterior of a half or more; the others go."""
    found = language.identified(docs.withColumn("row_key", _row(docs)), language.fit(docs), key="row_key")
    gone = stored(found.where("NOT accepted").select("row_key").distinct())
    return docs.withColumn("row_key", _row(docs)).join(gone, "row_key", "left_anti").select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores below its threshold; the others go. Labels of held-out rows are not learnt."""
    return toxicity.harmless(docs.select(*COLUMNS), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8 or more, the smallest id stays.

    Decisions are made on rows, each with its number by id and text, as ids may be there twice or missing; rows without an
    id come last. Of rows with the same id and text one stays.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_key")]
    rows = docs.withColumn("row_key", _row(docs)).repartitionByRange(*order).dropDuplicates(["doc_id", "row_key"])
    rows = stored(rows.sortWithinPartitions(*order).select(*COLUMNS, F.monotonically_increasing_id().alias("row_id")))
    found = setsketch.near_duplicates(rows, words=5, percent=80, key="row_id")
    gone = stored(found.where("NOT kept").select(F.col("doc_id").alias("row_id")))
    return rows.join(gone, "row_id", "left_anti").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes or more that are there more than once; rows of which nothing is left go."""
    found = repeats.without_repeats(docs, length=200, whole_characters=True, carry=("lang", "source"))
    found = found.where("n_removed < n_bytes OR n_bytes = 0").withColumn("text", F.col("kept").cast("string"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 1024 tokens."""
    return packing.pack(docs, queries.TOKENIZER)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", near_distinct),
    ("repeats", without_repeats),
    ("packing", packed),
]

#: SQL can express neither the models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
