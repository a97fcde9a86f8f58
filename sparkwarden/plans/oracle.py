"""Pieces of the comparison SQL: the same results by other means (prefix strings, joins, windows)."""

from __future__ import annotations

from collections.abc import Sequence

from sparkwarden.operators import provenance as prov
from sparkwarden.operators import secrets as sec
from sparkwarden.plans.domain import with_tables
from sparkwarden.sources.rules import STARTER_RULES, SecretRule


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern as SQL literal in the RE2 dialect (no possessive loops, no JVM-only flags)."""
    for old, new in (("*+", "*"), ("++", "+"), ("(?dU)", ""), ("(?d)", ""), ("(?md)", "(?m)")):
        pattern = pattern.replace(old, new)
    return quoted(pattern)


def spans(source: str, pattern: str, columns: str, text: str = "content") -> str:
    """Matches of a pattern with the text before them; positions follow from that text."""
    return f"""SELECT {columns}, p[i] AS text, array_to_string(p[1:i-1], '') AS before
      FROM (SELECT *, unnest(range(2, len(p) + 1, 2)) AS i
            FROM (SELECT {columns}, string_split(regexp_replace({text}, {re2('(' + pattern + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p
                  FROM {source} WHERE regexp_matches({text}, {re2(pattern)})))"""


def line_of(before: str) -> str:
    return f"(length({before}) - length(replace({before}, chr(10), '')) + 1)"


def col_of(before: str) -> str:
    return f"(length(string_split({before}, chr(10))[-1]) + 1)"


def place(before: str = "before", text: str = "text") -> str:
    both = f"({before} || {text})"
    return (
        f"{line_of(before)} AS start_line, {col_of(before)} AS start_col, "
        f"{line_of(both)} AS end_line, {col_of(both)} AS end_col"
    )


def entropy(text: str) -> str:
    return (
        f"coalesce(list_aggregate(list_transform(range(0, strlen({text})), lambda b: substr(hex({text}), b * 2 + 1, 2)), 'entropy'), 0)"
    )


def preview(text: str) -> str:
    return f"CASE WHEN strlen({text}) <= 50 THEN {text} ELSE substr({text}, 1, 50) || '…' END"


# Added before rounding, so that ties in the sixth digit go up in both engines.
UP = "1e-9"


def six(x: str) -> str:
    return f"round({x} + {UP}, 6)"


def ramp(x: str, lo: float, hi: float) -> str:
    return f"greatest(least(({x} - {lo}) / ({hi} - {lo}), 1.0), 0.0)"


def rule_match_rows(source: str, rules: Sequence[SecretRule] = tuple(STARTER_RULES)) -> str:
    """Matches of every rule."""
    rows = []
    for rule in rules:
        floor = "cast(NULL as double)" if rule.entropy is None else f"cast({rule.entropy} as double)"
        rows.append(
            f"SELECT *, {quoted(rule.rule_id)} AS rule, {quoted(rule.description)} AS description, "
            f"{quoted(rule.severity)} AS severity, {floor} AS floor FROM ({spans(source, rule.regex, 'repo, path, language')})"
        )
    return "\nUNION ALL ".join(rows)


def token_rows(source: str) -> str:
    """Comment and string tokens of the four languages."""
    rows = []
    for language, pattern in sec.TOKEN_PATTERNS.items():
        comment = "starts_with(text, '#')" if language == "python" else "(starts_with(text, '//') OR starts_with(text, '/*'))"
        char = "regexp_matches(text, '^b?''')" if language == "rust" else "false"
        body = spans(f"(SELECT * FROM {source} WHERE language = '{language}')", pattern, "repo, path, language")
        rows.append(
            f"SELECT *, CASE WHEN {comment} THEN 'comment' WHEN {char} THEN 'char' ELSE 'string' END AS kind, "
            f"length(before) AS s, length(before) + length(text) AS e FROM ({body})"
        )
    return "\nUNION ALL ".join(rows)


def marker_rows(source: str) -> str:
    """Allow markers by line, one row per allowed part."""
    one = r"secrets(?:\.[a-zA-Z0-9_.-]+)?"
    pattern = rf"audit:allow\s+({one}(?:\s*,\s*{one})*)"
    return f"""SELECT repo, path, line, regexp_replace(trim(part), '^secrets\\.?', '') AS rule_part FROM (
        SELECT repo, path, line, unnest(string_split(ids, ',')) AS part FROM (
          SELECT repo, path, n AS line, regexp_extract(ls[n], {quoted(pattern)}, 1) AS ids FROM (
            SELECT repo, path, ls, unnest(range(1, len(ls) + 1)) AS n FROM (
              SELECT repo, path, string_split(content, chr(10)) AS ls FROM {source} WHERE contains(content, 'audit:allow'))))
        WHERE ids <> '')"""


def literal_rows(tokens: str) -> str:
    """String literals with high entropy, by the tests for prose."""
    cleaned = "trim(text, chr(34) || chr(39) || chr(96))"
    spaces = "len(regexp_extract_all(t, '[ \\t\\n\\r\\f]'))"
    return f"""SELECT *, {entropy('t')} AS bits FROM (
        SELECT *, {cleaned} AS t FROM {tokens} WHERE kind = 'string')
      WHERE strlen(t) >= 20 AND {spaces} / strlen(t) <= 0.08
        AND NOT contains(t, '. ') AND NOT contains(t, ', ') AND NOT contains(t, '; ')
        AND round({entropy('t')}, 6) >= 4.5"""


def secret_ctes(source: str, prefix: str = "", rules: Sequence[SecretRule] = tuple(STARTER_RULES)) -> str:
    """CTEs up to ``<prefix>secret_rows``: findings of the secrets verifier over a files relation."""
    p = prefix
    return f"""
{p}matches AS MATERIALIZED ({rule_match_rows(source, rules)}),
{p}tokens AS MATERIALIZED ({token_rows(source)}),
{p}markers AS MATERIALIZED ({marker_rows(source)}),
{p}literals AS MATERIALIZED ({literal_rows(p + 'tokens')}),
{p}secret_rows AS MATERIALIZED (
  SELECT repo, path, 'secrets.' || rule AS rule_id, severity, description || ' (' || {preview('text')} || ')' AS message,
         {place()}, {preview('text')} AS snippet, '' AS metadata
  FROM {p}matches m
  WHERE (floor IS NULL OR round({entropy('text')}, 6) >= floor)
    AND NOT EXISTS (SELECT 1 FROM {p}markers k WHERE k.repo = m.repo AND k.path = m.path AND k.line = {line_of('m.before')}
                    AND contains(m.rule, k.rule_part))
    AND NOT EXISTS (SELECT 1 FROM {p}tokens t WHERE t.repo = m.repo AND t.path = m.path AND t.kind = 'comment'
                    AND length(m.before) >= t.s AND length(m.before) < t.e)
  UNION ALL
  SELECT repo, path, 'secrets.generic-high-entropy', 'medium',
         'High-entropy string literal (' || printf('%.1f', bits) || ' bits); may be a hardcoded credential',
         {place()}, {preview('t')}, 'entropy=' || cast(round(bits, 6) as varchar)
  FROM {p}literals l
  WHERE NOT EXISTS (SELECT 1 FROM {p}markers k WHERE k.repo = l.repo AND k.path = l.path AND k.line = {line_of('l.before')}
                    AND contains('generic-high-entropy', k.rule_part)))
"""


# --- provenance ---

def last_commit_cte() -> str:
    return """last_commit AS MATERIALIZED (
  SELECT repo, path, sha, author_ts, author_hour, message, additions FROM (
    SELECT t.*, c.author_ts, c.author_hour, c.message,
           row_number() OVER (PARTITION BY t.repo, t.path ORDER BY c.author_ts DESC, t.sha DESC) AS rn
    FROM (SELECT repo, path, sha, coalesce(sum(additions), 0) AS additions FROM commit_files GROUP BY ALL) t
    JOIN commits c ON c.repo = t.repo AND c.sha = t.sha) WHERE rn = 1)"""


COMMIT_MSG = "CASE WHEN regexp_matches(message, {0}) THEN 1.0 ELSE 0.0 END".format(
    quoted("(?i)" + "|".join(f"(?:{m})" for m in prov.COMMIT_MARKERS))
)
COMMIT_SIZE = f"CASE WHEN additions < 200 THEN 0.0 ELSE {ramp('additions', 200, 500)} END"
TIME_OF_DAY = "CASE WHEN author_hour BETWEEN 8 AND 22 OR author_hour IS NULL THEN 0.0 ELSE 1.0 END"


def _bytes(pattern: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(content, {quoted(pattern)}), lambda x: strlen(x))), 0)"


def docstring_sql() -> str:
    rust = (
        "coalesce(list_sum(list_transform(list_filter(string_split(content, chr(10)), "
        "lambda l: regexp_matches(l, '^\\s*//[/!]')), lambda l: strlen(l))), 0)"
    )
    doc = f"""CASE WHEN language = 'rust' THEN {rust}
        WHEN language IN ('typescript', 'javascript') THEN {_bytes(r'/[*](?:[*]/|[*](?s:.*?)(?:[*]/|$))')}
        WHEN language = 'python' THEN {_bytes('"""(?s:.*?)"""')} + {_bytes("'''(?s:.*?)'''")} ELSE 0 END"""
    share = f"coalesce(({doc}) / nullif(strlen(content), 0), 0)"
    return ramp(share, 0.10, 0.30)


def null_density_sql() -> str:
    checks = f"len(regexp_extract_all(content, {quoted(prov.NULL_CHECK)}))"
    flows = f"greatest(len(regexp_extract_all(content, {quoted(prov.CONTROL_FLOW)})), 1)"
    return ramp(f"{checks} / {flows}", 0.10, 0.30)


def marketing_sql() -> str:
    lower = "translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"least(len(regexp_extract_all({lower}, {quoted('|'.join(prov.PRAISE))})) / 3.0, 1.0)"


def imports_cte() -> str:
    """Imported names in order of appearance."""
    rust, script, python = (
        quoted(x) for x in (prov._RUST_IMPORT, prov._SCRIPT_IMPORT, prov._PYTHON_IMPORT)
    )
    name = "trim(string_split(trim(x), ' as ')[1])"
    return f"""import_lists AS MATERIALIZED (
  SELECT repo, path, language, content, CASE
    WHEN language = 'rust' THEN list_transform(regexp_extract_all(content, {rust}, 0),
         lambda m: CASE WHEN coalesce(regexp_extract(m, {rust}, 2), '') <> '' THEN regexp_extract(m, {rust}, 2) ELSE regexp_extract(m, {rust}, 1) END)
    WHEN language IN ('typescript', 'javascript') THEN list_filter(flatten(list_transform(regexp_extract_all(content, {script}, 0),
         lambda m: CASE WHEN coalesce(regexp_extract(m, {script}, 2), '') <> '' THEN [regexp_extract(m, {script}, 2)]
              ELSE list_transform(string_split(regexp_extract(m, {script}, 1), ','), lambda x: {name}) END)), lambda x: x <> '')
    WHEN language = 'python' THEN list_filter(flatten(list_transform(regexp_extract_all(content, {python}, 0),
         lambda m: list_transform(string_split(regexp_extract(m, {python}, 1), ','), lambda x: {name}))), lambda x: x <> '')
    ELSE [] END AS names FROM files),
import_rows AS MATERIALIZED (SELECT repo, path, language, content, unnest(names) AS name FROM import_lists)"""


UNUSED_CTE = f"""unused AS MATERIALIZED (
  SELECT repo, path, ({ramp("avg(CASE WHEN (strlen(content) - strlen(replace(content, name, ''))) / strlen(name) <= 1 THEN 1.0 ELSE 0.0 END)", 0.10, 0.40)}) AS v
  FROM import_rows GROUP BY repo, path)"""


def function_ctes() -> str:
    rows = "\nUNION ALL ".join(
        f"SELECT * FROM ({spans(f'(SELECT * FROM files WHERE language = {quoted(language)})', pattern, 'repo, path, language, content')})"
        for language, pattern in prov.FUNCTION_PATTERNS.items()
    )
    total = "(length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END)"
    return f"""function_at AS MATERIALIZED (SELECT repo, path, language, content, {line_of('before')} - 1 AS start_line FROM ({rows})),
function_rows AS MATERIALIZED (
  SELECT repo, path, language, start_line,
         coalesce(lead(start_line) OVER (PARTITION BY repo, path ORDER BY start_line), {total}) - start_line AS n_lines
  FROM function_at),
evenness AS MATERIALIZED (
  SELECT repo, path, CASE WHEN count(*) < 3 OR avg(n_lines) < 3 THEN 0.0
         ELSE {ramp('stddev_pop(n_lines) / avg(n_lines)', 0.4, 0.2)} END AS v
  FROM function_rows GROUP BY repo, path)"""


def score_ctes() -> str:
    """CTEs up to ``scored`` over files, commits and commit_files."""
    weighted = " + ".join(f"{w} * {n}" for n, w in prov.WEIGHTS.items())
    return f"""{last_commit_cte()},
{imports_cte()},
{UNUSED_CTE},
{function_ctes()},
signals AS MATERIALIZED (
  SELECT f.repo, f.path, f.language,
    coalesce({COMMIT_MSG.replace('message', 'l.message')}, 0.0) AS commit_msg,
    {COMMIT_SIZE.replace('additions', 'coalesce(l.additions, 0)')} AS commit_size,
    coalesce({TIME_OF_DAY.replace('author_hour', 'l.author_hour')}, 0.0) AS time_of_day,
    {docstring_sql()} AS docstring_ratio, {null_density_sql()} AS null_density, {marketing_sql()} AS marketing_comments,
    coalesce(u.v, 0.0) AS unused_imports, coalesce(e.v, 0.0) AS function_variance,
    CASE WHEN contains(content, 'audit:ai') THEN 1.0 WHEN contains(content, 'audit:human') THEN 0.0 END AS forced
  FROM files f LEFT JOIN last_commit l ON l.repo = f.repo AND l.path = f.path
  LEFT JOIN unused u ON u.repo = f.repo AND u.path = f.path
  LEFT JOIN evenness e ON e.repo = f.repo AND e.path = f.path),
scored AS MATERIALIZED (
  SELECT *, coalesce(forced, round(least({weighted}, 1.0) + {UP}, 6)) AS score FROM signals)"""


def tables(*names: str) -> str:
    return with_tables(*names)


# --- dependencies ---

def package_ctes() -> str:
    """CTEs up to ``parsed`` (all lockfiles) and ``chosen`` (first root lockfile that gives packages)."""
    name = "string_split(path, '/')[-1]"
    rows = f"SELECT repo, path, {name} AS lockfile, content FROM files WHERE {name} = "
    lines = f"""lock_lines AS MATERIALIZED (SELECT repo, path, lockfile, ls[n] AS line, n FROM (
      SELECT *, unnest(range(1, len(ls) + 1)) AS n FROM (
        SELECT repo, path, {name} AS lockfile, string_split(content, chr(10)) AS ls FROM files
        WHERE {name} IN ('pnpm-lock.yaml', 'yarn.lock', 'requirements.txt', 'go.sum'))))"""
    npm = f"""SELECT l.repo, l.path, l.lockfile, string_split(e.key, 'node_modules/')[-1] AS name, json_extract_string(e.value, '$.version') AS version
      FROM (SELECT * FROM ({rows} 'package-lock.json') WHERE json_valid(content)) l, json_each(l.content, '$.packages') e
      WHERE e.key <> '' AND json_extract_string(e.value, '$.version') IS NOT NULL"""
    pnpm_key = r"'^/([^(]*?)(?:\(.*)?:$'"
    pnpm = f"""SELECT repo, path, lockfile, regexp_extract(k, '^(@?[^@]*)@(.*)$', 1) AS name, regexp_extract(k, '^(@?[^@]*)@(.*)$', 2) AS version
      FROM (SELECT *, regexp_extract(trim(line), {pnpm_key}, 1) AS k FROM (
        SELECT *, last_value(flag IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY n) AS section FROM (
          SELECT *, CASE WHEN starts_with(line, 'packages:') THEN 1 WHEN line <> '' AND NOT starts_with(line, '  ') THEN 0 END AS flag
          FROM lock_lines WHERE lockfile = 'pnpm-lock.yaml'))
        WHERE section = 1 AND flag IS NULL AND starts_with(trim(line), '/') AND ends_with(trim(line), ':'))
      WHERE contains(k, '@')"""
    yarn = """SELECT repo, path, lockfile, any_value(name) AS name, arg_min(version, n) AS version FROM (
        SELECT *, sum(head) OVER (PARTITION BY repo, path ORDER BY n) AS block,
               CASE WHEN head = 1 THEN regexp_replace(trim(string_split(rtrim(line, ':'), ',')[1], chr(34)), '@[^@]*$', '') END AS name,
               CASE WHEN head = 0 AND starts_with(ltrim(line), 'version ') THEN trim(substr(ltrim(line), 9), chr(34)) END AS version
        FROM (SELECT *, CASE WHEN regexp_matches(line, '^[A-Za-z0-9"]') AND contains(string_split(line, ',')[1], '@') THEN 1 ELSE 0 END AS head
              FROM lock_lines WHERE lockfile = 'yarn.lock'))
      WHERE block > 0 GROUP BY repo, path, lockfile, block HAVING arg_min(version, n) IS NOT NULL"""
    toml = f"""SELECT repo, path, lockfile, name, version FROM (
        SELECT *, bool_and(name <> '' AND version <> '') OVER (PARTITION BY repo, path) AS whole FROM (
          SELECT repo, path, lockfile, regexp_extract(x, '(?m)^name = "([^"]*)"', 1) AS name, regexp_extract(x, '(?m)^version = "([^"]*)"', 1) AS version
          FROM (SELECT repo, path, lockfile, unnest(string_split(content, '[[package]]')[2:]) AS x
                FROM (SELECT repo, path, {name} AS lockfile, content FROM files WHERE {name} IN ('poetry.lock', 'Cargo.lock')))))
      WHERE whole"""
    pinned = """SELECT repo, path, lockfile, trim(substr(l, 1, strpos(l, '==') - 1)) AS name,
        trim(regexp_split_to_array(substr(l, strpos(l, '==') + 2), '[;, ]')[1]) AS version
      FROM (SELECT *, trim(line) AS l FROM lock_lines WHERE lockfile = 'requirements.txt')
      WHERE NOT starts_with(l, '#') AND NOT starts_with(l, '-r ') AND contains(l, '==')"""
    go = """SELECT DISTINCT repo, path, lockfile, string_split(line, ' ')[1] AS name, regexp_replace(string_split(line, ' ')[2], '/go[.]mod$', '') AS version
      FROM lock_lines WHERE lockfile = 'go.sum' AND len(string_split(line, ' ')) >= 2"""
    union = "\nUNION ALL ".join(f"SELECT * FROM ({part})" for part in (npm, pnpm, yarn, toml, pinned, go))
    return f"""{lines},
parsed AS MATERIALIZED (
  SELECT repo, path AS lockfile_path, lockfile,
    CASE lockfile WHEN 'poetry.lock' THEN 'PyPI' WHEN 'requirements.txt' THEN 'PyPI' WHEN 'go.sum' THEN 'Go' WHEN 'Cargo.lock' THEN 'Rust' ELSE 'npm' END AS ecosystem,
    CASE lockfile WHEN 'pnpm-lock.yaml' THEN 2 WHEN 'requirements.txt' THEN 2 WHEN 'yarn.lock' THEN 3 ELSE 1 END AS priority, name, version
  FROM ({union}) WHERE name <> '' AND version <> ''),
chosen AS MATERIALIZED (
  SELECT repo, lockfile_path, ecosystem, name, version FROM (
    SELECT *, dense_rank() OVER (PARTITION BY repo, ecosystem ORDER BY priority) AS rank FROM parsed WHERE NOT contains(lockfile_path, '/'))
  WHERE rank = 1)"""


def _key(v: str) -> str:
    core = f"list_transform(string_split(regexp_extract({v}, '^[0-9.]+'), '.'), lambda x: cast(x as bigint))"
    return f"list_append({core}, CASE WHEN contains({v}, '-') THEN 0 ELSE 1 END)"


def advisory_ctes() -> str:
    """CTE ``vulnerable``: chosen packages that meet no patched and no unaffected requirement."""
    return f"""
comparators AS MATERIALIZED (
  SELECT *, regexp_extract(c, '^(>=|>|<|\\^)', 1) AS op, {_key("regexp_extract(c, '([0-9].*)$', 1)")} AS k FROM (
    SELECT advisory_id, req, trim(unnest(string_split(req, ','))) AS c FROM (
      SELECT advisory_id, unnest(list_concat(patched, unaffected)) AS req FROM advisories))),
safe AS MATERIALIZED (
  SELECT DISTINCT advisory_id, version FROM (
    SELECT c.advisory_id, c.req, v.version, bool_and(CASE op WHEN '>=' THEN vk >= k WHEN '>' THEN vk > k WHEN '<' THEN vk < k
      ELSE vk >= k AND vk < CASE WHEN k[1] > 0 THEN [k[1] + 1, 0, 0, -1] WHEN k[2] > 0 THEN [0, k[2] + 1, 0, -1] ELSE [0, 0, k[3] + 1, -1] END END) AS ok
    FROM comparators c JOIN advisories a ON a.advisory_id = c.advisory_id
    JOIN (SELECT DISTINCT ecosystem, name, version, {_key('version')} AS vk FROM chosen WHERE ecosystem = 'Rust') v ON v.name = a.package
    GROUP BY ALL) WHERE ok),
vulnerable AS MATERIALIZED (
  SELECT p.*, a.* EXCLUDE (ecosystem) FROM chosen p JOIN advisories a ON a.ecosystem = p.ecosystem AND a.package = p.name
  WHERE NOT EXISTS (SELECT 1 FROM safe s WHERE s.advisory_id = a.advisory_id AND s.version = p.version)),
advisory_rows AS MATERIALIZED (
  SELECT repo, 'cve' AS verifier_id, 'cve.rust.' || advisory_id AS rule_id,
    CASE WHEN cvss IS NULL THEN 'high' WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS severity,
    name || ' ' || version || ': ' || title || ' ' || CASE WHEN len(patched) = 0 THEN '(no patched version available)'
      ELSE '(fixed in: ' || array_to_string(patched, ', ') || ')' END AS message,
    lockfile_path AS path, 1 AS start_line, 1 AS start_col, 1 AS end_line, 1 AS end_col, name || ' = "' || version || '"' AS snippet,
    cast(NULL as double) AS provenance_score,
    'advisory_id=' || advisory_id || ';package=' || name || ';patched_versions=' || coalesce(array_to_string(patched, ', '), '') || ';url=' || url || ';version=' || version AS metadata
  FROM vulnerable),
exact_rows AS MATERIALIZED (
  SELECT p.repo, 'cve' AS verifier_id, 'cve.' || lower(p.ecosystem) || '.' || vuln_id AS rule_id, 'high' AS severity,
    p.name || ' ' || p.version || ': see ' || vuln_id AS message, lockfile_path AS path, 1 AS start_line, 1 AS start_col, 1 AS end_line, 1 AS end_col,
    p.name || ' ' || p.version AS snippet, cast(NULL as double) AS provenance_score,
    'advisory_id=' || vuln_id || ';ecosystem=' || p.ecosystem || ';package=' || p.name || ';source=osv.dev;version=' || p.version AS metadata
  FROM chosen p JOIN (SELECT DISTINCT ecosystem, name, version, vuln_id FROM osv_vulns a WHERE vuln_id IS NOT NULL AND fetched_at =
      (SELECT max(fetched_at) FROM osv_vulns b WHERE b.ecosystem = a.ecosystem AND b.name = a.name AND b.version = a.version)) o
    ON o.ecosystem = p.ecosystem AND o.name = p.name AND o.version = p.version)"""


# --- the whole audit ---

IGNORED_CTE = """ignored AS MATERIALIZED (SELECT repo, path FROM (SELECT repo, path, r, s[1] AS d, cast(substr(s[2], 2) as bigint) AS m, s[3] AS f
    FROM (SELECT repo, path, cast(substr(repo, 2) as bigint) AS r, string_split(path, '/') AS s FROM files)
    WHERE len(s) = 3 AND s[1] IN ('vendor', 'tests', 'src'))
  WHERE d = 'vendor' OR (d = 'tests' AND m = r % 7) OR coalesce(CASE
    WHEN r % 3 = 0 AND f LIKE '%.ts' THEN true
    WHEN f = concat('f', r * 30 + 13, '.js') THEN false
    WHEN r % 2 = 0 AND d = 'src' AND m = (r + 1) % 7 THEN false
    WHEN d = 'src' AND m = r % 7 AND f LIKE '%.js' THEN true
    WHEN f LIKE '%.PY' THEN true END, false))"""

CODE_CTE = "code AS MATERIALIZED (SELECT * FROM files WHERE language IN ('rust', 'typescript', 'javascript', 'python'))"


def audit_ctes() -> str:
    """CTEs up to ``findings`` (flat) and ``runs`` for all files, history and advisories."""
    return (
        tables("files", "commits", "commit_files", "advisories", "osv_vulns")
        + f", {CODE_CTE}, {IGNORED_CTE}, {score_ctes()}, {secret_ctes('code')}, {package_ctes()}, {advisory_ctes()},"
        + """
runs AS MATERIALIZED (SELECT repo, count(*) AS candidates_scanned FROM files WHERE language <> 'unknown' AND (repo, path) NOT IN (SELECT repo, path FROM ignored) GROUP BY repo),
findings AS MATERIALIZED (
  SELECT s.repo, 'secrets' AS verifier_id, s.rule_id, s.severity, s.message, s.path, s.start_line, s.start_col, s.end_line, s.end_col, s.snippet,
         p.score AS provenance_score, s.metadata
  FROM secret_rows s JOIN scored p ON p.repo = s.repo AND p.path = s.path WHERE (s.repo, s.path) NOT IN (SELECT repo, path FROM ignored)
  UNION ALL SELECT * FROM advisory_rows UNION ALL SELECT * FROM exact_rows)
"""
    )


RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
