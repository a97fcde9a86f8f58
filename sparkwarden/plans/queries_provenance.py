"""Queries on the provenance score and its signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions.text import settled
from sparkwarden.operators import deadcode, imports, lockfiles
from sparkwarden.operators import provenance as prov
from sparkwarden.plans import oracle
from sparkwarden.plans.domain import LB_, RB_
from sparkwarden.plans.oracle import tables
from sparkwarden.plans.registry import Inputs, query

# The comparison SQL reads word classes as ASCII, so these queries do too.
ASCII = {"unicode": False}
_SCORED = tables("files", "commits", "commit_files") + ", " + oracle.score_ctes()


def _signal(spark, sf_dir, name):
    return prov.text_signals(Inputs(spark, sf_dir).files, **ASCII).select("repo", "path", settled(F.col(name)).alias(name))


def _scored(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return prov.provenance(t.files, t.commits, t.commit_files, **ASCII)


@query(
    tables("commits", "commit_files") + ", " + oracle.last_commit_cte()
    + " SELECT repo, path, sha, author_hour, message, additions FROM last_commit"
)
def last_commit_per_file(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return prov.last_commits(t.commits, t.commit_files, "author_hour", "message").drop("author_ts")


@query(tables("commits") + f"SELECT sha, {oracle.COMMIT_MSG} AS commit_msg FROM commits")
def signal_commit_msg(spark, sf_dir):
    return Inputs(spark, sf_dir).commits.select("sha", prov.commit_msg(F.col("message")).alias("commit_msg"))


@query(
    tables("commits", "commit_files") + ", " + oracle.last_commit_cte()
    + f" SELECT repo, path, {oracle.six(oracle.COMMIT_SIZE)} AS commit_size, {oracle.TIME_OF_DAY} AS time_of_day FROM last_commit"
)
def signals_commit_size_and_hour(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    rows = prov.commit_signals(t.commits, t.commit_files)
    return rows.select("repo", "path", settled(F.col("commit_size")).alias("commit_size"), "time_of_day")


@query(tables("files") + f"SELECT repo, path, {oracle.six(oracle.docstring_sql())} AS docstring_ratio FROM files")
def signal_docstring_ratio(spark, sf_dir):
    return _signal(spark, sf_dir, "docstring_ratio")


@query(tables("files") + f"SELECT repo, path, {oracle.six(oracle.null_density_sql())} AS null_density FROM files")
def signal_null_density(spark, sf_dir):
    return _signal(spark, sf_dir, "null_density")


@query(tables("files") + f"SELECT repo, path, {oracle.six(oracle.marketing_sql())} AS marketing_comments FROM files")
def signal_marketing_comments(spark, sf_dir):
    return _signal(spark, sf_dir, "marketing_comments")


@query(tables("files") + ", " + oracle.imports_cte() + " SELECT repo, path, language, name FROM import_rows")
def imported_names(spark, sf_dir):
    return prov.imports(Inputs(spark, sf_dir).files, **ASCII)


@query(
    tables("files") + ", " + oracle.imports_cte() + ", " + oracle.UNUSED_CTE
    + " SELECT f.repo, f.path, round(coalesce(v, 0.0) + 1e-9, 6) AS unused_imports FROM files f LEFT JOIN unused u ON u.repo = f.repo AND u.path = f.path"
)
def signal_unused_imports(spark, sf_dir):
    return _signal(spark, sf_dir, "unused_imports")


@query(tables("files") + ", " + oracle.function_ctes() + " SELECT repo, path, language, start_line, n_lines FROM function_rows")
def function_table(spark, sf_dir):
    return prov.functions(Inputs(spark, sf_dir).files, **ASCII)


@query(
    tables("files") + ", " + oracle.function_ctes()
    + " SELECT f.repo, f.path, round(coalesce(v, 0.0) + 1e-9, 6) AS function_variance FROM files f LEFT JOIN evenness u ON u.repo = f.repo AND u.path = f.path"
)
def signal_function_variance(spark, sf_dir):
    return _signal(spark, sf_dir, "function_variance")


@query(_SCORED + f" SELECT repo, path, score, forced IS NOT NULL AS override, {', '.join(f'{oracle.six(n)} AS {n}' for n in prov.WEIGHTS)} FROM scored")
def provenance_score(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(
    _SCORED + " "
    + " UNION ALL ".join(
        f"SELECT repo, path, '{name}' AS name, cast({weight} as double) AS weight, cast({oracle.six(name)} as double) AS value, "
        f"cast({oracle.six(f"{weight} * {oracle.six(name)}")} as double) AS contribution FROM scored"
        for name, weight in prov.WEIGHTS.items()
    )
)
def signal_contributions(spark, sf_dir):
    return prov.signals_long(_scored(spark, sf_dir))


@query(
    tables("files")
    + """SELECT repo, path, CASE WHEN contains(content, 'audit:ai') THEN 1.0 ELSE 0.0 END AS forced_score FROM files
       WHERE contains(content, 'audit:ai') OR contains(content, 'audit:human')"""
)
def inline_overrides(spark, sf_dir):
    files = Inputs(spark, sf_dir).files
    return files.select("repo", "path", prov.inline_override(F.col("content")).alias("forced_score")).where(
        F.col("forced_score").isNotNull()
    )


@query(_SCORED + " SELECT repo, path, score FROM scored WHERE round(score, 6) >= 0.5")
def likely_generated_files(spark, sf_dir):
    return prov.likely_generated(_scored(spark, sf_dir)).select("repo", "path", "score")


@query(
    tables("commits")
    + """SELECT repo, sha, CASE WHEN len(hours) > 0 THEN len(list_filter(hours, lambda h: h = author_hour)) / len(hours) END AS usual_share,
       coalesce(len(hours) >= 10 AND len(list_filter(hours, lambda h: h = author_hour)) / len(hours) < 0.05, false) AS unusual
    FROM (SELECT repo, sha, author_hour, coalesce(list(author_hour) OVER (PARTITION BY repo, author ORDER BY author_ts, sha ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), []) AS hours FROM commits)"""
)
def usual_commit_hours(spark, sf_dir):
    """Hours against the past of each author with the operator's own limits."""
    return prov.hour_anomalies(Inputs(spark, sf_dir).commits)


@query(
    tables("commits")
    + """SELECT repo, sha, CASE WHEN len(hours) > 0 THEN len(list_filter(hours, lambda h: h = author_hour)) / len(hours) END AS usual_share,
       coalesce(len(hours) >= 3 AND len(list_filter(hours, lambda h: h = author_hour)) / len(hours) < 0.2, false) AS unusual
    FROM (SELECT repo, sha, author_hour, coalesce(list(author_hour) OVER (PARTITION BY repo, author ORDER BY author_ts, sha ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS hours
          FROM (SELECT * REPLACE (concat('dev', cast(substr(author, 4) AS bigint) % 3) AS author) FROM commits))"""
)
def commit_hour_anomalies(spark, sf_dir):
    commits = Inputs(spark, sf_dir).commits
    # Three authors in each repository, so that they have a past.
    author = F.concat(F.lit("dev"), (F.expr("cast(substr(author, 4) as bigint)") % 3).cast("string"))
    return prov.hour_anomalies(commits.withColumn("author", author), past=5, least=3, usual=0.2)


_FAMILY = "CASE language WHEN 'python' THEN 'python' WHEN 'rust' THEN 'rust' WHEN 'javascript' THEN 'script' WHEN 'typescript' THEN 'script' WHEN 'go' THEN 'go' END"
_STANDARD = {f: ", ".join(f"'{m}'" for m in ms) for f, ms in imports.STANDARD.items()}

#: Statements are read line by line, by cutting strings; packages and roots are those that the files table is made with.
_IMPORTS_SQL = tables("code_files") + rf""",
    lines AS (SELECT repo, path, {_FAMILY} AS family, trim(unnest(string_split(content, chr(10)))) AS line FROM code_files),
    statements AS (SELECT repo, path, unnest(string_split(replace(line, 'try: ', ''), ';')) AS s FROM lines
      WHERE family = 'python' AND (starts_with(line, 'import ') OR starts_with(line, 'from ') OR starts_with(line, 'try: import '))),
    py AS (SELECT repo, path, string_split(trim(unnest(string_split(substr(trim(s), 8), ','))), ' ')[1] AS ref FROM statements WHERE starts_with(trim(s), 'import ')
      UNION SELECT repo, path, string_split(trim(s), ' ')[2] FROM statements WHERE starts_with(trim(s), 'from ') AND string_split(trim(s), ' ')[2] <> '.'),
    stems AS (SELECT repo, path, regexp_replace(path, '\.[a-z]+$', '') AS stem, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS folder,
              {_FAMILY} AS family FROM code_files),
    places AS (SELECT DISTINCT repo, family, array_to_string(string_split(stem, '/')[1:n], '/') AS place
      FROM (SELECT *, unnest(range(1, len(string_split(stem, '/')) + 1)) AS n FROM stems WHERE family IN ('python', 'script'))),
    roots AS (SELECT unnest(['', 'src/', 'lib/', 'app/', 'app/src/', 'app/lib/']) AS root),
    known AS (SELECT DISTINCT repo, family, substr(place, length(root) + 1) AS name FROM places, roots WHERE starts_with(place, root) AND length(place) > length(root)
      UNION SELECT repo, 'rust', CASE path WHEN 'Cargo.toml' THEN 'own_crate' ELSE 'ring' END FROM code_files WHERE path IN ('crates/ring/src/lib.rs', 'Cargo.toml')),
    cut AS (SELECT repo, path, ref, length(ref) - length(ltrim(ref, '.')) AS dots, string_split(ltrim(ref, '.'), '.') AS parts FROM py),
    reach AS (SELECT c.repo, c.path, c.ref, c.parts, c.dots, max(CASE
          WHEN dots = 0 AND (EXISTS (SELECT 1 FROM known k WHERE k.repo = c.repo AND k.family = 'python' AND k.name = array_to_string(c.parts[1:n], '/'))
            OR EXISTS (SELECT 1 FROM places p WHERE p.repo = c.repo AND p.family = 'python' AND p.place = array_to_string(s.folder, '/') || '/' || array_to_string(c.parts[1:n], '/'))) THEN n
          WHEN dots > 0 AND EXISTS (SELECT 1 FROM places p WHERE p.repo = c.repo AND p.family = 'python'
            AND p.place = array_to_string(s.folder[1:len(s.folder) - dots + 1] || c.parts[1:n], '/')) THEN n ELSE 0 END) AS n
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM cut) c JOIN stems s USING (repo, path) GROUP BY ALL),
    declared AS (SELECT repo, unnest(['quill_pad', 'only' || (cast(substr(repo, 2) AS bigint) % 3)]) AS name FROM code_files WHERE path = 'requirements.txt'),
    scripts AS (SELECT DISTINCT repo, path, CASE WHEN starts_with(m, '@') THEN array_to_string(string_split(m, '/')[1:2], '/') ELSE string_split(m, '/')[1] END AS module
      FROM (SELECT repo, path, string_split(replace(line, chr(34), chr(39)), chr(39))[2] AS m FROM lines
            WHERE family = 'script' AND (starts_with(line, 'import ') OR contains(line, 'require(') OR contains(line, '= import('))) WHERE NOT starts_with(m, '.')),
    rust AS (SELECT DISTINCT repo, path, module FROM (
        SELECT repo, path, string_split(trim(unnest(string_split(replace(replace(replace(line, 'use {LB_}', ''), 'use ', ''), ';', ''), ','))), '::')[1] AS module FROM lines
          WHERE family = 'rust' AND starts_with(line, 'use ')
        UNION ALL SELECT repo, path, string_split(rtrim(line, ';'), ' ')[3] FROM lines WHERE family = 'rust' AND starts_with(line, 'extern crate ')
        UNION ALL SELECT repo, path, string_split(trim(unnest(string_split(line, ';'))), '::')[1] FROM lines WHERE family = 'rust' AND contains(line, '::run('))),
    missing AS (SELECT repo, path, repeat('.', dots) || array_to_string(parts[1:n + 1], '.') AS module FROM reach r
      WHERE n < len(parts) AND NOT (dots = 0 AND (parts[1] IN ({_STANDARD['python']}) OR EXISTS (SELECT 1 FROM declared d WHERE d.repo = r.repo AND d.name = parts[1])))
      UNION ALL SELECT repo, path, module FROM scripts s WHERE module NOT IN ({_STANDARD['script']}) AND module <> 'own-pkg'
        AND NOT (module = '@s/p' AND EXISTS (SELECT 1 FROM code_files c WHERE c.repo = s.repo AND c.path = 'package-lock.json'))
        AND NOT EXISTS (SELECT 1 FROM known k WHERE k.repo = s.repo AND k.family = 'script' AND k.name = s.module)
      UNION ALL SELECT repo, path, CASE WHEN contains(module, ' as ') THEN string_split(module, ' ')[1] ELSE module END FROM rust r
        WHERE module NOT IN ({_STANDARD['rust']}) AND module <> 'g' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.repo = r.repo AND k.family = 'rust' AND k.name = r.module)),
    shown AS (SELECT DISTINCT m.* FROM missing m)
    SELECT repo, path, module, 'hallucination' AS verifier_id, 'hallucination.unresolved-import' AS rule_id, 'high' AS severity FROM shown
    WHERE module <> 'own-pkg' OR NOT EXISTS (SELECT 1 FROM code_files c WHERE c.repo = shown.repo AND c.path = 'package.json')"""


@query(_IMPORTS_SQL)
def unresolved_imports(spark, sf_dir):
    files = Inputs(spark, sf_dir).code_files
    return imports.unresolved_imports(files, lockfiles.all_packages(files, root_only=False))


#: Functions by lines: one reaches to the line before the next one that is not deeper; names are used along a recursive join.
_DEAD_SQL = tables("code_files") + rf""",
    lines AS MATERIALIZED (SELECT repo, path, family, i, line, nullif(regexp_extract(line, '^(?:pub |export )?(?:def|fn|func|function) ([A-Za-z0-9_]+)\(', 1), '') AS name
      FROM (SELECT repo, path, {_FAMILY} AS family, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i
            FROM code_files WHERE language <> 'unknown')),
    owned AS (SELECT *, max(CASE WHEN name IS NOT NULL THEN i WHEN line <> '' AND NOT starts_with(line, ' ') AND line <> '{RB_}' THEN -i END)
                OVER (PARTITION BY repo, path ORDER BY i ROWS UNBOUNDED PRECEDING) AS last_head,
                max(CASE WHEN name IS NULL AND line <> '' AND NOT starts_with(line, ' ') AND line <> '{RB_}' THEN i END)
                OVER (PARTITION BY repo, path ORDER BY i ROWS UNBOUNDED PRECEDING) AS last_other FROM lines),
    placed AS MATERIALIZED (SELECT repo, path, family, i, line, name, CASE WHEN last_head > coalesce(last_other, 0) THEN last_head END AS head FROM owned),
    functions AS MATERIALIZED (SELECT repo, path, family, i, name, starts_with(line, 'pub ') OR starts_with(line, 'export ') OR
        (family IN ('python', 'go') AND NOT starts_with(name, '_')) AS root FROM placed WHERE name IS NOT NULL),
    mentions AS (SELECT DISTINCT repo, path, family, head, unnest(regexp_extract_all(
        CASE family WHEN 'python' THEN string_split(line, '#')[1] ELSE string_split(line, '//')[1] END, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM placed WHERE name IS NULL),
    calls AS MATERIALIZED (SELECT DISTINCT m.repo, m.family, f.name AS caller, coalesce(f.root, true) AS root, m.name FROM mentions m
      LEFT JOIN functions f ON f.repo = m.repo AND f.path = m.path AND f.i = m.head WHERE starts_with(m.name, '_')),
    used AS (WITH RECURSIVE u AS (SELECT repo, family, name FROM calls WHERE root
      UNION SELECT c.repo, c.family, c.name FROM calls c JOIN u ON u.repo = c.repo AND u.family = c.family AND u.name = c.caller WHERE NOT c.root) SELECT * FROM u)
    SELECT repo, path, name, i::INT AS start_line, 'deadcode' AS verifier_id, 'deadcode.unused-function' AS rule_id, 'low' AS severity FROM functions f
    WHERE NOT root AND NOT EXISTS (SELECT 1 FROM used u WHERE u.repo = f.repo AND u.family = f.family AND u.name = f.name)"""


@query(_DEAD_SQL)
def dead_functions(spark, sf_dir):
    return deadcode.dead_functions(Inputs(spark, sf_dir).code_files)
