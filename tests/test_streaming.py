"""Lookups of a stream: asked again only when the last answer is too old, in one batch or in many."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators.findings import weekly_counts
from sparkwarden.operators.secrets import SecretOptions
from sparkwarden.streaming import incremental as inc

SCHEMA = "ecosystem string, name string, version string, fetched_at timestamp"
HOURS = [("a", 0), ("a", 10), ("a", 24), ("a", 24.5), ("a", 96), ("b", 30), ("a", 192), ("b", 31)]
WANT = [("a", 0.0), ("a", 24.5), ("a", 96.0), ("a", 192.0), ("b", 30.0)]


@pytest.mark.parametrize("files", [1, 4])
def test_lookups_once(spark, tmp_path, files):
    begin = dt.datetime(2024, 1, 1)
    rows = [("npm", n, "1", begin + dt.timedelta(hours=h)) for n, h in HOURS]
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = inc.lookups_once(stream).collect()
    assert sorted((r.name, (r.asked_at - begin).total_seconds() / 3600) for r in got) == WANT


def test_lookups_go_on_after_a_restart(spark, tmp_path):
    begin = dt.datetime(2024, 1, 1)
    rows = [("npm", n, "1", begin + dt.timedelta(hours=h)) for n, h in HOURS] + [("npm", "a", "1", None), (None, None, None, begin), (None, None, None, begin)]
    got = []
    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        got = inc.lookups_once(stream, base=str(tmp_path / "out")).collect()
    assert sorted((r.name, (r.asked_at - begin).total_seconds() / 3600) for r in got if r.name) == WANT
    assert [(r.ecosystem, r.asked_at) for r in got if not r.name] == [(None, begin)]


def test_state_goes_with_the_time_to_live(spark, tmp_path):
    begin = dt.datetime(2024, 1, 1)
    for hour, name in ((0, "a"), (200, "b"), (201, "b"), (400, "a")):
        spark.createDataFrame([("npm", name, "1", begin + dt.timedelta(hours=hour))], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        found = inc.due_lookups(stream, delay="1 hour")
        query = found.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept == 1


def test_weekly_counts_keep_files_without_history(spark):
    found = spark.createDataFrame([("r", ("a",)), ("r", ("a",)), ("r", ("b",))], "repo string, location struct<path:string>")
    last = spark.createDataFrame([("r", "a", dt.datetime(2024, 1, 3))], "repo string, path string, author_ts timestamp")
    got = weekly_counts(found, last).select(F.col("week").cast("string").alias("week"), "n").collect()
    assert {(r.week, r.n) for r in got} == {("2023-12-28 00:00:00", 2), (None, 1)}


def test_changes_of_findings(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    key = lambda c: f'x = "AKIA{c}QWERTYU1234567{c}"\n'
    batches = [
        [("a.py", key("B"), day(1)), ("a.py", key("B") + key("B"), day(2)), ("b.py", "x = 1", day(1)), ("z.txt", key("B"), day(1))],
        [("a.py", "\n\n" + key("B") + key("C"), day(3)), ("a.py", "", day(2)), ("a.py", key("D"), day(1)), ("b.py", key("C"), day(5))],
        [("a.py", key("C"), day(6)), ("a.py", key("C"), day(6)), ("b.py", key("C"), day(4)), ("c.py", key("D"), None)],
        [("a.py", None, day(7)), ("b.py", key("D"), day(8)), ("b.py", "", day(9))],
    ]
    schema = "repo string, path string, language string, content string, seen_at timestamp"
    got = None
    for batch in batches:
        rows = [("r", p, "python" if p.endswith("py") else "unknown", c, t) for p, c, t in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = inc.run_to_table(inc.finding_changes(stream, SecretOptions(literals=False)), str(tmp_path / "out")).collect()
    aws = [r for r in got if r.rule_id == "secrets.aws-access-token"]
    assert sorted((r.path, r.seen_at.day, r.change, r.snippet[4]) for r in aws) == [
        ("a.py", 1, "added", "B"), ("a.py", 3, "added", "C"), ("a.py", 6, "resolved", "B"), ("a.py", 7, "resolved", "C"),
        ("b.py", 5, "added", "C"), ("b.py", 8, "added", "D"), ("b.py", 8, "resolved", "C"), ("b.py", 9, "resolved", "D"),
    ]


def test_files_of_one_bucket_keep_their_own_versions(spark, tmp_path):
    """Many files share a state, also those without a path; it goes on in the next run."""
    schema = "repo string, path string, language string, content string, seen_at timestamp"
    key = "AKIA" + "QWERTYUIOPASDFG"

    def run(day, letter):
        rows = [("r", p, "python", f'k = "{key}{letter}"\n' if p != "c.py" else None, dt.datetime(2024, 1, day)) for p in ("a.py", "b.py", "c.py", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        found = inc.finding_changes(stream, SecretOptions(literals=False), buckets=1)
        return inc.run_to_table(found, str(tmp_path / "out")).where("rule_id = 'secrets.aws-access-token'")

    assert run(1, "B").count() == 3
    got = run(2, "C").collect()
    assert sorted((r.path or "", r.seen_at.day, r.change) for r in got) == sorted(
        (p, *change) for p in ("", "a.py", "b.py") for change in ((1, "added"), (2, "added"), (2, "resolved"))
    )


def test_versions_are_made_in_the_stream(spark, tmp_path):
    """No copy of the texts is written for each version."""
    from pathlib import Path

    from sparkwarden.plans.all_queries import QUERIES
    from sparkwarden.session import shared_dir

    spark.range(12, 100).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("versions-*"))
    assert QUERIES["stream_finding_changes"](spark, str(tmp_path)).count() > 0
    assert set(Path(shared_dir(spark).removeprefix("file:")).glob("versions-*")) == before
