"""Commit tables from exported history.

Export with (one record per commit, fields split by U+001F, records by U+001E)::

    git -c core.quotePath=false log --no-renames --raw --numstat --format='%x1e%H%x1f%an%x1f%aI%x1f%B%x1f'
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RECORD, FIELD = "\x1e", "\x1f"


def read_log(spark: SparkSession, path: str, repo: str | None = None, named: bool = False) -> DataFrame:
    """Raw records of exported histories: ``repo, sha, author, authored, message, changes``.

    Without ``repo`` the repository is that of the folder, if folders are named ``repo=<name>``, and else the file's name
    without its ending: one read for the histories of many repositories. With ``named`` each record begins with its
    repository as a field of its own (``--format='%x1e<name>%x1f%H...'``): very many histories then fit into few files.
    """
    record = F.split(F.col("value"), FIELD, -1)
    if named:
        name, record = F.nullif(record[0], F.lit("")), F.slice(record, F.lit(2), F.size(record))
    rows = spark.read.option("lineSep", RECORD).text(path)
    by_file = name if named else F.col("repo").cast("string") if "repo" in rows.columns else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return (
        rows.where(F.contains("value", F.lit(FIELD)))
        .select(
            (F.lit(repo) if repo is not None else by_file).alias("repo"),
            record[0].alias("sha"),
            record[1].alias("author"),
            record[2].alias("authored"),
            F.regexp_replace(record[3], F.lit("\n+$"), F.lit("")).alias("message"),
            record[4].alias("changes"),
        )
    )


def commits_of(log: DataFrame) -> DataFrame:
    """Commits table. The hour is the author's local one, so it is read from the text, not from the instant."""
    return log.select(
        "repo",
        "sha",
        "author",
        F.to_timestamp("authored").alias("author_ts"),
        F.substring("authored", 12, 2).cast("int").alias("author_hour"),
        "message",
    )


def unquoted(path: Column) -> Column:
    """The path that git put in quotes: octal bytes, tabs, line feeds, quotes and backslashes spelled out.

    Each escape or run of plain text becomes bytes; the bytes together are the path's UTF-8.
    """
    inner = F.substring(path, F.lit(2), F.length(path) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(r"(\\[0-7]{3}|\\.|[^\\]+)"), F.lit(1))
    simple = F.create_map(*[F.lit(x) for k, v in (("t", "09"), ("n", "0A"), ("r", "0D"), ('"', "22"), ("\\", "5C")) for x in (k, v)])
    hexed = F.transform(
        pieces,
        lambda p: F.when(p.rlike(r"^\\[0-7]{3}$"), F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0"))
        .when(F.startswith(p, F.lit("\\")), F.coalesce(F.try_element_at(simple, F.substring(p, 2, 1)), F.hex(p)))
        .otherwise(F.hex(p)),
    )
    quoted = F.startswith(path, F.lit('"')) & F.endswith(path, F.lit('"')) & (F.length(path) > 1)
    return F.when(quoted, F.decode(F.unhex(F.array_join(hexed, "")), "UTF-8")).otherwise(path)


def commit_files_of(log: DataFrame) -> DataFrame:
    """Changed paths per commit with status and line counts; ``-`` counts (binary files) become null."""
    line = log.select("repo", "sha", F.explode(F.split("changes", "\n")).alias("line")).where(F.col("line") != "")
    tab = F.split("line", "\t", -1)
    raw = F.startswith("line", F.lit(":"))
    parsed = line.select(
        "repo",
        "sha",
        unquoted(F.when(raw, tab[1]).otherwise(F.get(tab, F.lit(2)))).alias("path"),
        F.when(raw, F.substring(F.regexp_extract(tab[0], r"([A-Z])\d*$", 1), 1, 1)).alias("status"),
        F.when(~raw, tab[0].try_cast("bigint")).alias("additions"),
        F.when(~raw, F.get(tab, F.lit(1)).try_cast("bigint")).alias("deletions"),
    )
    return parsed.groupBy("repo", "sha", "path").agg(
        F.max("status").alias("status"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.lit(False).alias("staged"),
    )
