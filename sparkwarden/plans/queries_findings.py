"""Queries on the merged findings and on reports."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window, functions as F

from sparkwarden import __version__
from sparkwarden.functions.severity import SEVERITIES, parse_severity, severity_rank
from sparkwarden.operators import findings as fnd
from sparkwarden.operators import reports
from sparkwarden.operators.asof import asof_join
from sparkwarden.operators.findings import for_languages
from sparkwarden.operators.lockfiles import LOCKFILES
from sparkwarden.operators.provenance import last_commits
from sparkwarden.operators.secrets import LANGUAGES, SecretOptions, secret_findings
from sparkwarden.plans.audit import COUNTED, DESCRIBED, FIRST, VERIFIERS, AuditOptions, Tables, audit, audited
from sparkwarden.plans.oracle import CODE_CTE, IGNORED_CTE, RANK, audit_ctes, package_ctes, secret_ctes, tables
from sparkwarden.plans.queries_discovery import DIFF_CTES, refs_of
from sparkwarden.plans.registry import Inputs, flat, metadata_text, query
from sparkwarden.session import shared_dir, stored

OPTIONS = AuditOptions(secrets=SecretOptions(unicode=False))
AUDIT = audit_ctes()
_COLUMNS = "repo, verifier_id, rule_id, severity, message, path, start_line, start_col, end_line, end_col, snippet, provenance_score, metadata"


def tables_of(spark, sf_dir, **more):
    t = Inputs(spark, sf_dir)
    return Tables(t.files, t.commits, t.commit_files, t.advisories, t.osv_vulns, **more)


def _found(spark, sf_dir, options=OPTIONS, also=None):
    return audit(tables_of(spark, sf_dir), options, also)


def _reported(spark, sf_dir):
    """Findings that know the first place of their repository's report, the scanned files of the same audit, and the audit.

    The findings are not written: reports read them row by row.
    """
    done = audited(tables_of(spark, sf_dir), OPTIONS, several=True)
    return done.findings_as(firsts=stored(fnd.first_places(done.findings_as(FIRST)))), done.runs, done


def _counted(spark, sf_dir):
    """The same for counts: findings are numbers of rows that are not made one by one."""
    done = audited(tables_of(spark, sf_dir), OPTIONS, form=COUNTED)
    return done.findings, done.runs


@query(AUDIT + f"SELECT {_COLUMNS} FROM findings")
def audit_findings(spark, sf_dir):
    return flat(_found(spark, sf_dir, also=metadata_text()))


@query(AUDIT + f"SELECT {_COLUMNS} FROM findings WHERE verifier_id = 'secrets' AND round(provenance_score, 6) >= 0.5")
def audit_generated_only(spark, sf_dir):
    return flat(_found(spark, sf_dir, AuditOptions(ai_only=True, skip=["cve"], secrets=OPTIONS.secrets)))


@query(AUDIT + f"SELECT {_COLUMNS.replace('provenance_score', 'cast(NULL as double) AS provenance_score')} FROM findings WHERE verifier_id = 'secrets'")
def audit_without_detection(spark, sf_dir):
    return flat(_found(spark, sf_dir, AuditOptions(detect=False, verifiers=["secrets"], secrets=OPTIONS.secrets)))


@query(
    AUDIT + f""", {DIFF_CTES}
    SELECT s.repo, 'secrets' AS verifier_id, s.rule_id, s.severity, s.message, s.path, s.start_line, s.start_col, s.end_line, s.end_col, s.snippet,
           p.score AS provenance_score, s.metadata
    FROM secret_rows s JOIN scored p ON p.repo = s.repo AND p.path = s.path WHERE (s.repo, s.path) IN (SELECT repo, path FROM diff_paths)
    UNION ALL SELECT c.* REPLACE (CASE WHEN d.path IS NOT NULL THEN p.score END AS provenance_score)
    FROM (SELECT * FROM advisory_rows UNION ALL SELECT * FROM exact_rows) c LEFT JOIN scored p ON p.repo = c.repo AND p.path = c.path
    LEFT JOIN (SELECT DISTINCT repo, path FROM diff_paths) d ON d.repo = c.repo AND d.path = c.path"""
)
def audit_changed_files(spark, sf_dir):
    tables = tables_of(spark, sf_dir, refs=refs_of(Inputs(spark, sf_dir).files))
    return flat(audit(tables, OPTIONS, metadata_text()))


@query(
    AUDIT + """, staged_paths AS MATERIALIZED (SELECT DISTINCT repo, path FROM commit_files WHERE staged AND status IN ('A', 'C', 'M', 'R'))
    SELECT s.repo, s.path, s.rule_id, s.start_line, s.start_col, p.score AS provenance_score FROM secret_rows s
    JOIN scored p ON p.repo = s.repo AND p.path = s.path WHERE (s.repo, s.path) IN (SELECT repo, path FROM staged_paths)"""
)
def audit_staged_files(spark, sf_dir):
    found = audit(tables_of(spark, sf_dir), AuditOptions(staged=True, verifiers=["secrets"], secrets=OPTIONS.secrets))
    return found.select("repo", "location.path", "rule_id", "location.start_line", "location.start_col", "provenance_score")


@query(
    AUDIT + f"""SELECT repo, severity, path, start_line, start_col, rule_id, provenance_score,
    rank() OVER (ORDER BY repo, coalesce(provenance_score, 0) DESC, {RANK} DESC, path, start_line, start_col, rule_id) AS position FROM findings"""
)
def findings_in_order(spark, sf_dir):
    # The place of a row in the sorted table; equal rows share the first place, so that order is compared as a value.
    found = fnd.sort_findings(_found(spark, sf_dir), ai_priority=True).select(
        "repo", "severity", "location.path", "location.start_line", "location.start_col", "rule_id", "provenance_score"
    )
    # Part files in name order hold the sorted rows.
    file, row = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    placed = stored(found).select("*", file, row)
    parts = placed.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    before = parts.select("file", (F.sum("rows").over(Window.orderBy("file")) - F.col("rows")).alias("before"))
    rows = placed.join(before, "file").withColumn("position", F.col("row") + F.col("before") + 1).drop("file", "row", "before")
    equal = Window.partitionBy("repo", "path", "start_line", "start_col", "rule_id", "severity", "provenance_score")
    return rows.withColumn("position", F.min("position").over(equal))


@query(
    AUDIT + "SELECT r.repo, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEVERITIES)
    + " FROM runs r LEFT JOIN findings f ON f.repo = r.repo GROUP BY r.repo"
)
def findings_by_severity(spark, sf_dir):
    return fnd.counts_by_severity(*_counted(spark, sf_dir))


@query(AUDIT + f"SELECT r.repo, max({RANK}) FILTER (WHERE severity IS NOT NULL) AS worst, coalesce(max({RANK}) FILTER (WHERE severity IS NOT NULL) < 4, true) AS passed FROM runs r LEFT JOIN findings f ON f.repo = r.repo GROUP BY r.repo")
def gate_on_critical(spark, sf_dir):
    found, runs = _counted(spark, sf_dir)
    return fnd.gate(found, "CRITICAL", runs)


@query(AUDIT + f"SELECT {_COLUMNS} FROM findings WHERE {RANK} >= 3")
def findings_at_least_high(spark, sf_dir):
    return flat(fnd.at_least(_found(spark, sf_dir, also=metadata_text()), "high"))


@query(
    AUDIT + """SELECT repo, path, rule_id, start_line, start_col, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level,
    coalesce(round(provenance_score, 6) >= 0.5, false) AS ai_likely FROM findings"""
)
def levels_and_ai_flag(spark, sf_dir):
    rows = fnd.with_levels(_found(spark, sf_dir))
    return rows.select("repo", "location.path", "rule_id", "location.start_line", "location.start_col", "level", "ai_likely")


_DESCRIPTORS = f"SELECT repo, rule_id, arg_min(message, (-({RANK}), path, start_line, start_col, rule_id, message)) AS full_text FROM findings GROUP BY repo, rule_id"


@query(AUDIT + _DESCRIPTORS)
def rule_descriptors(spark, sf_dir):
    found = audited(tables_of(spark, sf_dir), OPTIONS, form=DESCRIBED).findings
    return fnd.rule_descriptors(found, VERIFIERS).select("repo", "rule_id", "full_text")


@query(AUDIT + "SELECT repo, verifier_id, severity, count(*) AS n FROM findings GROUP BY ROLLUP (repo, verifier_id, severity)")
def severity_rollup(spark, sf_dir):
    return fnd.severity_rollup(_counted(spark, sf_dir)[0])


@query("SELECT o_orderkey, CASE lower(s) WHEN 'none' THEN 'info' ELSE lower(s) END AS severity, CASE lower(s) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank FROM (SELECT o_orderkey, replace(replace(substr(o_orderpriority, 3), 'NOT SPECIFIED', 'None'), 'URGENT', 'Critical') AS s FROM orders)")
def severity_names(spark, sf_dir):
    text = F.replace(
        F.replace(F.expr("substr(o_orderpriority, 3)"), F.lit("NOT SPECIFIED"), F.lit("None")), F.lit("URGENT"), F.lit("Critical")
    )
    name = parse_severity(text)
    return Inputs(spark, sf_dir).orders.select("o_orderkey", name.alias("severity"), severity_rank(name).alias("rank"))


@query(
    AUDIT + f"""SELECT {_COLUMNS} FROM findings f WHERE EXISTS (SELECT 1 FROM commit_files h WHERE h.repo = f.repo AND h.path = f.path
    AND f.start_line >= h.start_line AND f.start_line < h.end_line)"""
)
def findings_on_changed_lines(spark, sf_dir):
    hunks = Inputs(spark, sf_dir).commit_files.select("repo", "path", "start_line", "end_line")
    return flat(audit(tables_of(spark, sf_dir, hunks=hunks), OPTIONS, metadata_text()))


@query(
    AUDIT + """SELECT time_bucket(INTERVAL 7 DAYS, l.author_ts, TIMESTAMP '1970-01-01 00:00:00') AS week, f.repo, count(*) AS n
    FROM findings f LEFT JOIN last_commit l ON l.repo = f.repo AND l.path = f.path GROUP BY 1, 2"""
)
def findings_per_week(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return fnd.weekly_counts(_counted(spark, sf_dir)[0], last_commits(t.commits, t.commit_files))


@query(
    tables("files") + ", " + package_ctes() + f""", {IGNORED_CTE} SELECT DISTINCT repo, 'sub/.ignore' AS path, 'discovery' AS verifier_id, 'invalid ignore rule in line 2: [a' AS reason FROM files
    UNION ALL SELECT repo, path, 'secrets', 'not valid UTF-8' FROM files WHERE language <> 'unknown' AND k % 17 = 0 AND (repo, path) NOT IN (SELECT repo, path FROM ignored)
    UNION ALL SELECT repo, path, 'cve', 'no packages in lockfile' FROM files f WHERE path IN ({", ".join(f"'{p}'" for p in LOCKFILES)})
      AND NOT EXISTS (SELECT 1 FROM parsed p WHERE p.repo = f.repo AND p.lockfile_path = f.path)"""
)
def audit_errors(spark, sf_dir):
    files = Inputs(spark, sf_dir).files
    files = files.withColumn("content", F.when((F.col("k") % 17 != 0) | (F.col("language") == "unknown"), F.col("content"))).drop("k")
    bad = files.select("repo").distinct().select(
        "repo", F.lit("sub/.ignore").alias("path"), F.lit("unknown").alias("language"), F.lit("# one bad line\n[a\n").alias("content")
    )
    return audited(Tables(files.unionByName(bad)), AuditOptions(detect=False, secrets=OPTIONS.secrets)).errors


_FOUND_AT = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(regexp_extract(path, '/f([0-9]+)[.]', 1) as int) * 37 % 50000)"


@query(
    tables("files", "commits") + f", {CODE_CTE}, {secret_ctes('code')}," + r"""
    f AS (SELECT CASE WHEN n % 2 = 0 THEN 'r0' ELSE repo END AS repo, path, rule_id, start_line, start_col, TIMESTAMP '2024-01-01' + to_minutes(n * 37 % 50000) AS found_at
      FROM (SELECT *, cast(regexp_extract(path, '/f([0-9]+)[.]', 1) as bigint) AS n FROM secret_rows)),
    c AS (SELECT repo, author_ts, max(sha) AS sha FROM (SELECT CASE WHEN cast(substr(repo, 2) as bigint) % 2 = 0 THEN 'r0' ELSE repo END AS repo, author_ts, sha FROM commits) GROUP BY ALL)
    SELECT f.repo, path, rule_id, start_line, start_col, found_at, c.sha, c.author_ts FROM f ASOF LEFT JOIN c ON f.repo = c.repo AND f.found_at >= c.author_ts"""
)
def findings_at_commit(spark, sf_dir):
    """Each secret with the commit in force when it was found; one repository has half of all rows."""
    t = Inputs(spark, sf_dir)
    found = secret_findings(for_languages(t.files, LANGUAGES), OPTIONS.secrets).select("repo", "location.path", "rule_id", "location.start_line", "location.start_col")
    found = found.withColumn("found_at", F.expr(_FOUND_AT)).withColumn("repo", F.expr("CASE WHEN cast(regexp_extract(path, '/f([0-9]+)[.]', 1) as int) % 2 = 0 THEN 'r0' ELSE repo END"))
    commits = t.commits.select(F.expr("CASE WHEN cast(substr(repo, 2) as bigint) % 2 = 0 THEN 'r0' ELSE repo END").alias("repo"), "author_ts", "sha")
    return asof_join(found, commits, ["repo"], "found_at", "author_ts", tie=["sha"])


def _marked_files(files):
    """A user's own verifier: files with an override marker."""
    marked = files.where(F.contains("content", F.lit("audit:ai")) | F.contains("content", F.lit("audit:human")))
    return marked.select("repo", "path", F.lit("markers.override").alias("rule_id"), F.lit("info").alias("severity"), F.lit("override").alias("message"), F.lit(1).alias("start_line"))


MARKERS = fnd.UserVerifier("markers", "Files with an override marker", _marked_files)


@query(
    AUDIT + """SELECT f.repo, 'markers' AS verifier_id, 'markers.override' AS rule_id, 'info' AS severity, 'override' AS message, f.path, 1 AS start_line,
      p.score AS provenance_score
    FROM files f JOIN scored p ON p.repo = f.repo AND p.path = f.path
    WHERE f.language <> 'unknown' AND (f.repo, f.path) NOT IN (SELECT repo, path FROM ignored) AND (contains(f.content, 'audit:ai') OR contains(f.content, 'audit:human'))
    UNION ALL SELECT repo, verifier_id, rule_id, severity, message, path, start_line, provenance_score FROM findings WHERE verifier_id = 'secrets'"""
)
def audit_user_verifier(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    options = AuditOptions(secrets=OPTIONS.secrets, user_verifiers=[MARKERS], skip=["cve"])
    found = audit(Tables(t.files.drop("k"), t.commits, t.commit_files), options)
    return flat(found).select("repo", "verifier_id", "rule_id", "severity", "message", "path", "start_line", "provenance_score")


@query(AUDIT + f"SELECT {_COLUMNS} FROM findings")
def findings_table(spark, sf_dir):
    # Written as the table sink writes it, and read back.
    path = f"{shared_dir(spark)}/findings-{uuid4().hex}"
    reports.write_findings(_found(spark, sf_dir), path)
    return flat(spark.read.parquet(path))


# --- reports ---

def _json(x: str) -> str:
    return f"cast(to_json({x}) as varchar)"


_PAIRS = (
    "'{' || array_to_string(list_transform(string_split(metadata, ';'), lambda e: to_json(regexp_extract(e, '^([^=]*)=', 1)) || ':' "
    "|| to_json(regexp_replace(e, '^[^=]*=', ''))), ',') || '}'"
)
# The pairs of a finding in the order they are written.
_META = (
    "CASE WHEN metadata = '' THEN '' WHEN verifier_id = 'secrets' THEN ',\"metadata\":' || " + _PAIRS
    + " ELSE ',\"metadata\":{' || array_to_string(list_transform(CASE WHEN contains(metadata, 'patched_versions=') THEN ['advisory_id','package','version','patched_versions','url'] "
    "ELSE ['advisory_id','package','version','ecosystem','source'] END, lambda k: to_json(k) || ':' || "
    "to_json(regexp_extract(metadata, '(?:^|;)' || k || '=([^;]*)', 1))), ',') || '}' END"
)
_META = f"""regexp_replace({_META}, '"entropy":"([0-9]+(?:\\.[0-9]+)?)"', '"entropy":\\1')"""
_SCORE = "CASE WHEN provenance_score IS NULL THEN '' ELSE ',\"provenance_score\":' || cast(provenance_score as varchar) END"
_FINDING = (
    "'{\"verifier_id\":\"' || verifier_id || '\",\"rule_id\":\"' || rule_id || '\",\"severity\":\"' || severity || '\",\"message\":' || "
    + _json("message") + " || ',\"location\":{\"path\":' || " + _json("path")
    + " || ',\"start_line\":' || start_line || ',\"start_col\":' || start_col || ',\"end_line\":' || end_line || ',\"end_col\":' || end_col || "
    "',\"snippet\":' || " + _json("snippet") + " || '}' || " + _SCORE + " || " + _META + " || '}'"
)
_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
_SARIF = (
    "'{\"ruleId\":\"' || rule_id || '\",\"level\":\"' || " + _LEVEL + " || '\",\"message\":{\"text\":' || " + _json("message")
    + " || '},\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":' || " + _json("path")
    + " || '},\"region\":{\"startLine\":' || start_line || ',\"startColumn\":' || start_col || ',\"endLine\":' || end_line || ',\"endColumn\":' || end_col || "
    "',\"snippet\":{\"text\":' || " + _json("snippet") + " || '}}}}],\"properties\":{\"audit\":{\"verifier_id\":\"' || verifier_id || '\"' || "
    + _SCORE + " || ',\"ai_likely\":' || CASE WHEN coalesce(round(provenance_score, 6) >= 0.5, false) THEN 'true' ELSE 'false' END || " + _META + " || '}}}'"
)


def _listed(section: int, body: str) -> str:
    return (
        f"SELECT repo, {section} AS section, CASE WHEN row_number() OVER (PARTITION BY repo ORDER BY {RANK} DESC, path, start_line, start_col, rule_id, body) = 1 "
        f"THEN body ELSE ',' || body END AS line FROM (SELECT *, {body} AS body FROM findings)"
    )


_VERIFIER_LIST = ",".join(f'"{v}"' for v in VERIFIERS)


@query(
    AUDIT + f"""SELECT repo, 0 AS section, '{{"$schema":"{reports.JSON_SCHEMA}","version":"{__version__}","run":{{"tool_version":"{__version__}","duration_ms":1500,"candidates_scanned":' || candidates_scanned || ',"verifiers_run":[{_VERIFIER_LIST}]}},"findings":[' AS line FROM runs
    UNION ALL {_listed(1, _FINDING)} UNION ALL SELECT repo, 2, ']}}' FROM runs"""
)
def json_report(spark, sf_dir):
    found, runs, _ = _reported(spark, sf_dir)
    lines = reports.json_lines(found, runs, VERIFIERS, duration_ms=1500)
    return lines.select("repo", "place.section", "line")


_OWN_RULES = ",".join(
    f'{{"id":"{k}","shortDescription":{{"text":"{v}"}},"fullDescription":{{"text":"{v}"}}}}' for k, v in VERIFIERS.items()
)


@query(
    AUDIT + f"""SELECT repo, 0 AS section, '{{"$schema":"{reports.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{reports.TOOL}","informationUri":"urn:sparkwarden","version":"{__version__}","rules":[{_OWN_RULES}' AS line FROM runs
    UNION ALL SELECT repo, 1, ',{{"id":"' || rule_id || '","shortDescription":{{"text":"' || rule_id || '"}},"fullDescription":{{"text":' || {_json('full_text')} || '}}}}' FROM ({_DESCRIPTORS})
    UNION ALL SELECT repo, 2, ']}}}},"results":[' FROM runs UNION ALL {_listed(3, _SARIF)} UNION ALL SELECT repo, 4, ']}}]}}' FROM runs"""
)
def sarif_report(spark, sf_dir):
    found, runs, done = _reported(spark, sf_dir)
    lines = reports.sarif_lines(found, runs, VERIFIERS, described=done.findings_as(DESCRIBED))
    return lines.select("repo", "place.section", "line")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEVERITIES)


@query(
    AUDIT + f"""SELECT repo, 0 AS section, '{reports.TOOL} v{__version__}  ·  scanned ' || candidates_scanned || ' file(s) in 1.50s' || chr(10) AS line FROM runs
    UNION ALL SELECT repo, 1, rpad(upper(severity), 9, ' ') || ' ' || path || ':' || rpad(cast(start_line as varchar), cast(greatest(5, length(cast(start_line as varchar))) as int), ' ') || '  ' || rule_id || chr(10) || '          ' || message FROM findings
    UNION ALL SELECT repo, 2, CASE WHEN n = 0 THEN '0 findings' ELSE chr(10) || {" || ' · ' || ".join(f"{s} || ' {s}'" for s in SEVERITIES)} END
    FROM (SELECT r.repo, count(f.rule_id) AS n, {_COUNTS} FROM runs r LEFT JOIN findings f ON f.repo = r.repo GROUP BY r.repo)"""
)
def text_report(spark, sf_dir):
    done = audited(tables_of(spark, sf_dir), OPTIONS, several=True)
    lines = reports.text_lines(done.findings, done.runs, duration_ms=1500, counted=done.findings_as(COUNTED))
    return lines.select("repo", "place.section", "line")
