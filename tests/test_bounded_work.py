"""Work that is left out because it cannot change a result, and the results around it."""

from pyspark.sql import functions as F

from sparkwarden.operators import hunks
from sparkwarden.plans import domain


def test_parts_without_common_lines_are_not_compared(monkeypatch):
    def never(*_):
        raise AssertionError("nothing in common")

    monkeypatch.setattr(hunks, "_common", never)
    old, new = ["a", "x", "x", "y", "b", "z", "z", "c"], ["a", "u", "v", "v", "b", "w", "w", "w", "c"]
    assert hunks.matched_lines(old, new) == [(0, 0), (4, 4), (7, 8)]


def test_hunks_of_many_files_come_in_few_batches(spark, monkeypatch):
    monkeypatch.setattr(hunks, "BATCH", 7)
    files = [("r", f"f{i}", "".join(f"{j}\n" for j in range(9))) for i in range(30)] + [("r", "same", "1\n")]
    after = [(r, p, t if p == "same" else t.replace("3\n", "x\n").replace("7\n", "")) for r, p, t in files]
    schema = "repo string, path string, content string"
    rows = hunks.snapshot_hunks(spark.createDataFrame(files, schema), spark.createDataFrame(after, schema)).collect()
    want = sorted((f"f{i}", *h) for i in range(30) for h in [(4, 5, 4, 5), (8, 8, 8, 9)])
    assert sorted(tuple(r)[1:] for r in rows) == want


def test_derived_answers_are_spread(spark, tmp_path):
    parts = [(k, f"name {k}", k % 50, 900.0 + k) for k in range(300)]
    df = spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_retailprice double")
    df.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    answers = domain.table(spark, str(tmp_path), "osv_vulns")
    held = answers.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in held) == 2700
    assert len(held) > 1
