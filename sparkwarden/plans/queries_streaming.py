"""Streaming queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.plans import domain, oracle
from sparkwarden.plans.oracle import tables
from sparkwarden.plans.queries_secrets import CODE, FLAT, OPTIONS
from sparkwarden.plans.registry import Inputs, flat, query
from sparkwarden.streaming import incremental as inc


def _stream(spark, sf_dir, name):
    """A derived table as a stream of its given table."""
    source, stages = domain.TABLES[name]
    schema = spark.read.parquet(f"{sf_dir}/{source}.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", f"{source}.parquet").parquet(sf_dir)
    for stage in stages(domain.Spark):
        df = df.selectExpr(*stage)
    return df


def _file_stream(spark, sf_dir):
    """The written files table as the folder that new files arrive in."""
    files = Inputs(spark, sf_dir).files
    folder = files.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(files.schema).parquet(folder)


def _commit_stream(spark, sf_dir):
    rows = _stream(spark, sf_dir, "commits")
    return rows.withColumn("author_ts", F.col("author_ts").cast("timestamp"))


@query(CODE + "," + oracle.secret_ctes("code") + f"SELECT {FLAT} FROM secret_rows")
def stream_secret_findings(spark, sf_dir):
    return flat(inc.run_to_table(inc.scan_new_files(_file_stream(spark, sf_dir), OPTIONS)))


@query(
    tables("osv_vulns").replace("WITH ", "WITH RECURSIVE ", 1) + """, asks AS (SELECT ecosystem, name, version, min(fetched_at) AS asked_at FROM osv_vulns GROUP BY ALL
      UNION ALL SELECT a.ecosystem, a.name, a.version, min(o.fetched_at) FROM asks a JOIN osv_vulns o ON o.ecosystem = a.ecosystem AND o.name = a.name
        AND o.version = a.version AND o.fetched_at > a.asked_at + INTERVAL 24 HOURS GROUP BY a.ecosystem, a.name, a.version, a.asked_at)
    SELECT * FROM asks"""
)
def stream_lookups_once(spark, sf_dir):
    rows = _stream(spark, sf_dir, "osv_vulns").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return inc.lookups_once(rows).withColumn("asked_at", F.col("asked_at").cast("timestamp_ntz"))


@query(
    tables("commits") + f"""SELECT * FROM (SELECT time_bucket(INTERVAL 7 DAYS, author_ts, TIMESTAMP '1970-01-01 00:00:00') AS week, repo, count(*) AS commits,
      cast(sum({oracle.COMMIT_MSG}) as bigint) AS marked FROM commits GROUP BY 1, 2)
    WHERE week + INTERVAL 7 DAYS <= (SELECT max(author_ts) FROM commits) - INTERVAL 1 HOUR"""
)
def stream_weekly_commits(spark, sf_dir):
    return inc.run_to_table(inc.weekly_commits(_commit_stream(spark, sf_dir))).withColumn(
        "week", F.col("week").cast("timestamp_ntz")
    )


@query(
    tables("commits") + """, marked AS (SELECT *, CASE WHEN author_ts < lag(author_ts) OVER (PARTITION BY repo, author ORDER BY author_ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM commits),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY repo, author ORDER BY author_ts, sha) AS burst FROM marked)
    SELECT min(author_ts) AS first_ts, repo, author, count(*) AS commits FROM numbered GROUP BY repo, author, burst
    HAVING max(author_ts) + INTERVAL 30 MINUTES <= (SELECT max(author_ts) FROM commits) - INTERVAL 1 HOUR"""
)
def stream_commit_bursts(spark, sf_dir):
    return inc.run_to_table(inc.commit_bursts(_commit_stream(spark, sf_dir))).withColumn(
        "first_ts", F.col("first_ts").cast("timestamp_ntz")
    )


#: Three versions of each file: as it is, with its key ids gone in some and a new one in others, and then gone in some.
_VERSION = """CASE v WHEN 1 THEN content
  WHEN 2 THEN CASE k % 3 WHEN 0 THEN replace(content, 'AKIA', 'none') WHEN 1 THEN concat(content, chr(10), 'pat = ', chr(34), 'ghp_', substr(md5(concat('v', k)), 1, 32), 'abcd', chr(34), chr(10)) ELSE content END
  WHEN 3 THEN CASE k % 5 WHEN 0 THEN NULL ELSE content END END"""


@query(
    tables("files") + f""", versions AS MATERIALIZED (SELECT repo, concat(path, '@', v) AS path, language, {_VERSION} AS content FROM files, (VALUES (1), (2), (3)) AS n(v)
      WHERE language IN ('rust', 'typescript', 'javascript', 'python')), texts AS (SELECT * FROM versions WHERE content IS NOT NULL), {oracle.secret_ctes('texts')},
    ids AS MATERIALIZED (SELECT DISTINCT repo, string_split(path, '@')[1] AS path, cast(string_split(path, '@')[2] AS int) AS v, rule_id, snippet FROM secret_rows)
    SELECT repo, path, rule_id, snippet, 'added' AS change, TIMESTAMP '2024-01-01' + to_days(v) AS seen_at FROM ids a
      WHERE NOT EXISTS (SELECT 1 FROM ids b WHERE b.repo = a.repo AND b.path = a.path AND b.rule_id = a.rule_id AND b.snippet = a.snippet AND b.v = a.v - 1)
    UNION ALL SELECT repo, path, rule_id, snippet, 'resolved', TIMESTAMP '2024-01-01' + to_days(v + 1) FROM ids a
      WHERE v < 3 AND NOT EXISTS (SELECT 1 FROM ids b WHERE b.repo = a.repo AND b.path = a.path AND b.rule_id = a.rule_id AND b.snippet = a.snippet AND b.v = a.v + 1)"""
)
def stream_finding_changes(spark, sf_dir):
    """Versions of all files arrive as a stream, the last ones a second time; changes of findings come out."""
    # Versions are made as the written files arrive: a copy of each text per version would be written and read for nothing.
    files = _file_stream(spark, sf_dir)
    versions = files.withColumn("v", F.explode(F.array(*[F.lit(v) for v in (1, 2, 3, 3)])))
    stream = versions.select("repo", "path", "language", F.expr(_VERSION).alias("content"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, v)").alias("seen_at"))
    return inc.run_to_table(inc.finding_changes(stream, OPTIONS)).withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))
