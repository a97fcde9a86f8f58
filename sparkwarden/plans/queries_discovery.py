"""Queries on sources and discovery."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from sparkwarden.operators import discovery, findings, hunks
from sparkwarden.plans.oracle import tables
from sparkwarden.plans.registry import Inputs, query
from sparkwarden.session import shared_dir
from sparkwarden.sources import commits as log
from sparkwarden.sources.files import as_files

EXCLUDE = ["vendor/*", "**/m3/*.js", "*[", "tests/**/f?[0-3]*.ts"]

_EXT = "regexp_extract(path, '[^/][^/]*\\.([^./]*)$', 1)"
_LANGUAGE = f"""CASE lower({_EXT}) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript'
    WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' ELSE 'unknown' END"""
_KNOWN = f"SELECT repo, path, {_LANGUAGE} AS language FROM files"


@query(tables("files") + f"SELECT repo, path, {_EXT} AS ext, {_LANGUAGE} AS language, strlen(content) AS n_bytes FROM files")
def corpus_files(spark, sf_dir):
    return as_files(Inputs(spark, sf_dir).files.select("repo", "path", "content")).drop("content")


@query("SELECT source AS repo, count(*) AS n FROM documents WHERE NOT (doc_id % 3 = 0 AND strlen(text) < 8192) GROUP BY source")
def binary_sniff(spark, sf_dir):
    docs = Inputs(spark, sf_dir).documents
    data = F.encode("text", "UTF-8")
    rows = docs.select(
        F.col("source").alias("repo"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(data, F.lit(b"\x00"))).otherwise(data).alias("content"),
    )
    return as_files(rows).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS repo, count(*) AS n_files, count(*) FILTER (WHERE doc_id % 4 <> 0) AS n_text FROM documents GROUP BY source")
def utf8_text_only(spark, sf_dir):
    docs = Inputs(spark, sf_dir).documents
    data = F.encode("text", "UTF-8")
    rows = docs.select(
        F.col("source").alias("repo"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(data, F.lit(b"\xff"))).otherwise(data).alias("content"),
    )
    return as_files(rows).groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.count("content").alias("n_text"))


@query(tables("files") + f"SELECT path, language FROM ({_KNOWN}) WHERE language <> 'unknown'")
def known_languages(spark, sf_dir):
    return discovery.by_language(as_files(Inputs(spark, sf_dir).files)).select("path", "language")


@query(tables("files") + f"SELECT path, language FROM ({_KNOWN}) WHERE language IN ('rust', 'python')")
def listed_languages(spark, sf_dir):
    return discovery.by_language(as_files(Inputs(spark, sf_dir).files), ["rust", "python"]).select("path", "language")


@query(
    tables("files")
    + """SELECT repo, path FROM files WHERE NOT (starts_with(path, 'vendor/') OR regexp_matches(path, '^(.*/)?m3/.*\\.js$')
       OR contains(path, '*[') OR regexp_matches(path, '^tests/(.*/)?f.[0-3].*\\.ts$'))"""
)
def exclude_globs(spark, sf_dir):
    return discovery.not_excluded(Inputs(spark, sf_dir).files, EXCLUDE).select("repo", "path")


_IGNORE_LINES = """SELECT repo, path, ordinal, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (
    SELECT repo, path, 0 AS ordinal, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM files WHERE path IN ('.gitignore', '.auditignore'))"""


@query(
    tables("files")
    + f"""SELECT repo, CASE path WHEN '.gitignore' THEN 0 ELSE 2 END AS kind, n AS ordinal,
       regexp_replace(line, '^!', '') AS pattern, starts_with(line, '!') AS negated, ends_with(line, '/') AS dir_only
    FROM ({_IGNORE_LINES}) WHERE line <> '' AND NOT starts_with(line, '#')"""
)
def ignore_rules(spark, sf_dir):
    rules = discovery.ignore_rules(Inputs(spark, sf_dir).files)
    return rules.select("repo", "kind", "ordinal", "pattern", "negated", "dir_only")


_PARTS = """SELECT repo, path, cast(substr(repo, 2) as bigint) AS r, string_split(path, '/') AS s FROM files"""


@query(
    tables("files")
    + f"""SELECT repo, path FROM (SELECT repo, path, r, s[1] AS d, cast(substr(s[2], 2) as bigint) AS m, s[3] AS f
           FROM ({_PARTS}) WHERE len(s) = 3 AND s[1] IN ('vendor', 'tests', 'src'))
       WHERE d = 'vendor' OR (d = 'tests' AND m = r % 7) OR coalesce(CASE
         WHEN r % 3 = 0 AND f LIKE '%.ts' THEN true
         WHEN f = concat('f', r * 30 + 13, '.js') THEN false
         WHEN r % 2 = 0 AND d = 'src' AND m = (r + 1) % 7 THEN false
         WHEN d = 'src' AND m = r % 7 AND f LIKE '%.js' THEN true
         WHEN f LIKE '%.PY' THEN true END, false)"""
)
def ignored_files(spark, sf_dir):
    files = Inputs(spark, sf_dir).files
    return discovery.ignored_paths(files.select("repo", "path"), discovery.ignore_rules(files))


@query(tables("commit_files") + "SELECT DISTINCT repo, path FROM commit_files WHERE status IN ('A', 'C', 'M', 'R')")
def changed_files(spark, sf_dir):
    return discovery.changed_paths(Inputs(spark, sf_dir).commit_files)


# Every third repository names its commit number 5, every third number 12, the others a commit that does not exist.
_REFS = """refs AS MATERIALIZED (SELECT DISTINCT repo, CASE cast(substr(repo, 2) as bigint) % 3 WHEN 0 THEN md5(concat('c', cast(substr(repo, 2) as bigint) * 20 + 5))
    WHEN 1 THEN md5(concat('c', cast(substr(repo, 2) as bigint) * 20 + 12)) ELSE 'none' END AS ref FROM files)"""


def refs_of(files):
    number = F.substring(F.col("repo"), F.lit(2), F.length("repo")).cast("long")
    first = F.md5(F.concat(F.lit("c"), (number * 20 + 5).cast("string")).cast("binary"))
    second = F.md5(F.concat(F.lit("c"), (number * 20 + 12).cast("string")).cast("binary"))
    ref = F.when(number % 3 == 0, first).when(number % 3 == 1, second).otherwise(F.lit("none"))
    return files.select("repo").distinct().select("repo", ref.alias("ref"))


DIFF_CTES = f"""{_REFS},
later AS MATERIALIZED (SELECT c.repo, c.sha, c.author_ts FROM commits c JOIN refs r ON r.repo = c.repo
  JOIN commits b ON b.repo = r.repo AND b.sha = r.ref WHERE c.author_ts > b.author_ts),
net AS MATERIALIZED (SELECT cf.repo, cf.path, arg_max(cf.status, (l.author_ts, l.sha, cf.status)) AS status
  FROM commit_files cf JOIN later l ON l.repo = cf.repo AND l.sha = cf.sha GROUP BY cf.repo, cf.path),
diff_paths AS MATERIALIZED (
  SELECT repo, path FROM files WHERE (repo, path) IN (SELECT repo, path FROM net WHERE status IN ('A', 'C', 'M', 'R'))
  UNION ALL SELECT f.repo, f.path FROM files f JOIN refs r ON r.repo = f.repo
  WHERE NOT EXISTS (SELECT 1 FROM commits c WHERE c.repo = r.repo AND c.sha = r.ref))"""


@query(tables("files", "commits", "commit_files") + f", {DIFF_CTES} SELECT repo, path FROM diff_paths")
def diff_since_ref(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return discovery.change_set(t.files, t.commits, t.commit_files, refs_of(t.files))


@query(
    tables("files", "commits") + f", {_REFS} SELECT repo, ref FROM refs r WHERE NOT EXISTS (SELECT 1 FROM commits c WHERE c.repo = r.repo AND c.sha = r.ref)"
)
def unknown_refs(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return discovery.unknown_refs(t.commits, refs_of(t.files))


@query(
    tables("files", "commit_files")
    + "SELECT repo, path FROM files WHERE (repo, path) IN (SELECT repo, path FROM commit_files WHERE staged AND status IN ('A', 'C', 'M', 'R'))"
)
def staged_files(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return discovery.staged_paths(t.files, t.commit_files)


@query(
    tables("files")
    + """SELECT repo, path, CASE WHEN k % 13 = 0 THEN 'A' WHEN k % 11 = 0 THEN 'D' ELSE 'M' END AS status FROM files
    WHERE (k % 13 = 0) <> (k % 11 = 0) OR (k % 7 = 0 AND k % 13 <> 0 AND k % 11 <> 0)"""
)
def snapshot_diff(spark, sf_dir):
    files = Inputs(spark, sf_dir).files
    old = files.where("k % 13 <> 0")
    edited = F.when(F.col("k") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    return discovery.compare_snapshots(old, files.where("k % 11 <> 0").withColumn("content", edited))


@query(tables("files") + "SELECT repo, count(*) AS candidates_scanned FROM files WHERE language <> 'unknown' GROUP BY repo")
def candidate_counts(spark, sf_dir):
    return findings.candidate_counts(discovery.by_language(Inputs(spark, sf_dir).files))


@query(tables("commits") + "SELECT repo, sha, author, author_ts, author_hour, regexp_replace(message, '\\n+$', '') AS message FROM commits")
def exported_commits(spark, sf_dir):
    # The commits written as exported histories, each record with its repository, and read back.
    commits = Inputs(spark, sf_dir).commits
    fields = ["sha", "author", F.date_format("author_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"), "message", F.lit("\n")]
    record = F.concat(F.lit(log.RECORD), F.coalesce("repo", F.lit("")), F.lit(log.FIELD), F.concat_ws(log.FIELD, *fields))
    base = f"{shared_dir(spark)}/history-{uuid4().hex}"
    commits.select(record.alias("value")).write.option("lineSep", "\n").text(base)
    read = log.commits_of(log.read_log(spark, base, named=True))
    return read.withColumn("author_ts", F.col("author_ts").cast("timestamp_ntz"))


@query(
    tables("commit_files")
    + """SELECT repo, sha, path, max(status) AS status, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, false AS staged
    FROM commit_files GROUP BY repo, sha, path"""
)
def exported_commit_files(spark, sf_dir):
    """Change lines of an exported history with statuses, counts, binary files and quoted paths, read back."""
    changes = Inputs(spark, sf_dir).commit_files
    path = F.when(F.octet_length("path") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit('"'), F.replace("path", F.lit("/"), F.lit(r"\057")), F.lit('"')))
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    raw = F.concat(F.lit(":100644 100644 0a1b2c3 4d5e6f7 "), "status", F.lit("\t"), path)
    lines = F.concat_ws("\n", raw, F.concat_ws("\t", count("additions"), count("deletions"), path))
    grouped = changes.groupBy("repo", "sha").agg(F.concat_ws("\n", F.collect_list(lines)).alias("changes"))
    fields = ["sha", F.lit("dev"), F.lit("2024-01-01T00:00:00+00:00"), F.lit("message"), F.concat(F.lit("\n"), "changes", F.lit("\n"))]
    record = F.concat(F.lit(log.RECORD), F.coalesce("repo", F.lit("")), F.lit(log.FIELD), F.concat_ws(log.FIELD, *fields))
    base = f"{shared_dir(spark)}/history-{uuid4().hex}"
    grouped.select(record.alias("value")).write.option("lineSep", "\n").text(base)
    return log.commit_files_of(log.read_log(spark, base, named=True))


# Ignore files at the root and in folders: line, its regex for paths below the folder (written by hand), whether it must be a
# folder. The weight of the file's kind comes first, the depth of its folder second, the line last.
_NESTED = [
    ("", 0, ".gitignore", ["# all", "*.ts", "!keep[0-9].ts", "[broken", "\\#x", "m3/"]),
    ("src", 0, ".gitignore", ["!*.ts", "/m1", "m2/*.py"]),
    ("", 1, ".ignore", ["f*[02468].js", "tests/**/f*1.*", "back\\"]),
    ("tests", 2, ".auditignore", ["!f?1.go", "m5", "[!a-z]*"]),
]
_NESTED_RULES = [
    ("", 0, 1, r"(.*/)?[^/]*\.ts", False, False), ("", 0, 2, r"(.*/)?keep[0-9]\.ts", True, False), ("", 0, 4, "(.*/)?#x", False, False),
    ("", 0, 5, "(.*/)?m3", False, True), ("src", 0, 0, r"(.*/)?[^/]*\.ts", True, False), ("src", 0, 1, "m1", False, False),
    ("src", 0, 2, r"m2/[^/]*\.py", False, False), ("", 1, 0, r"(.*/)?f[^/]*[02468]\.js", False, False),
    ("", 1, 1, r"tests/(.*/)?f[^/]*1\.[^/]*", False, False), ("tests", 2, 0, r"(.*/)?f[^/]1\.go", True, False),
    ("tests", 2, 1, "(.*/)?m5", False, False), ("tests", 2, 2, "(.*/)?[^a-z][^/]*", False, False),
]


@query(
    tables("files")
    + ", rules(dir, kind, ordinal, regex, negated, dir_only) AS (VALUES "
    + ", ".join(f"('{d}', {k}, {o}, '{r}', {n}, {f})" for d, k, o, r, n, f in _NESTED_RULES)
    + """), parts AS (SELECT repo, path, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM files),
    hits AS (SELECT repo, path, n, max_by(negated, (kind, depth, ordinal)) AS kept FROM (
      SELECT p.*, r.*, CASE r.dir WHEN '' THEN 0 ELSE 1 END AS depth FROM parts p JOIN rules r ON (r.dir = '' OR (s[1] = r.dir AND n > 1)) AND (NOT dir_only OR n < len(s)))
      WHERE regexp_full_match(array_to_string(s[depth + 1:n], '/'), regex) GROUP BY repo, path, n)
    SELECT DISTINCT repo, path FROM hits WHERE NOT kept"""
)
def ignored_files_nested(spark, sf_dir):
    files = Inputs(spark, sf_dir).files
    rows = [(f"{d}/{name}".lstrip("/"), lines) for d, _, name, lines in _NESTED]
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.array(*[F.lit(x) for x in lines]).alias("lines")) for p, lines in rows])
    rules = files.select("repo").distinct().select("repo", F.explode(each).alias("f")).select("repo", "f.path", "f.lines")
    return discovery.ignored_paths(files.select("repo", "path"), discovery.rules_of_lines(rules))


_LINES = "SELECT *, row_number() OVER (PARTITION BY repo, path, line ORDER BY i) AS n FROM (SELECT repo, path, unnest(l[:-2]) AS line, generate_subscripts(l[:-2], 1) AS i FROM (SELECT repo, path, string_split(content, chr(10)) AS l FROM {0}))"


@query(
    tables("old_files", "new_files") + f""",
    o AS MATERIALIZED ({_LINES.format('old_files')}), n AS MATERIALIZED ({_LINES.format('new_files')}),
    kept AS (SELECT n.repo, n.path, n.i AS y, o.i AS x FROM n JOIN o ON o.repo = n.repo AND o.path = n.path AND o.line = n.line AND o.n = n.n
      UNION ALL SELECT f.repo, f.path, coalesce((SELECT max(i) FROM n WHERE n.repo = f.repo AND n.path = f.path), 0) + 1,
        coalesce((SELECT max(i) FROM o WHERE o.repo = f.repo AND o.path = f.path), 0) + 1 FROM new_files f),
    steps AS (SELECT repo, path, y, x, coalesce(lag(y) OVER w, 0) AS y0, coalesce(lag(x) OVER w, 0) AS x0 FROM kept WINDOW w AS (PARTITION BY repo, path ORDER BY y))
    SELECT repo, path, (y0 + 1)::INT AS start_line, y::INT AS end_line, (x0 + 1)::INT AS old_start, x::INT AS old_end FROM steps WHERE y > y0 + 1 OR x > x0 + 1"""
)
def snapshot_hunks(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return hunks.snapshot_hunks(t.old_files, t.new_files)
