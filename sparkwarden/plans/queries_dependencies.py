"""Queries on lockfiles and vulnerabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions.paths import basename
from sparkwarden.functions.semver import semver_key, with_requirements
from sparkwarden.functions.severity import cvss_severity
from sparkwarden.operators import licenses
from sparkwarden.operators import lockfiles as locks
from sparkwarden.operators import vulnerabilities as vul
from sparkwarden.plans import oracle
from sparkwarden.plans.oracle import tables
from sparkwarden.plans.registry import Inputs, flat, metadata_text, query

_PARSED = tables("files") + ", " + oracle.package_ctes()
_PARSED_ROWS = "SELECT repo, lockfile_path, ecosystem, name, version FROM parsed WHERE lockfile = '{}'"
_VULNERABLE = tables("files", "advisories", "osv_vulns") + ", " + oracle.package_ctes() + "," + oracle.advisory_ctes()
AS_OF = "2024-01-03 12:00:00"


def _parsed(spark, sf_dir, lockfile):
    files = Inputs(spark, sf_dir).files.where(basename(F.col("path")) == lockfile)
    return locks.all_packages(files, root_only=False)


@query(_PARSED + _PARSED_ROWS.format("package-lock.json"))
def packages_npm_lock(spark, sf_dir):
    return _parsed(spark, sf_dir, "package-lock.json")


@query(_PARSED + _PARSED_ROWS.format("pnpm-lock.yaml"))
def packages_pnpm_lock(spark, sf_dir):
    return _parsed(spark, sf_dir, "pnpm-lock.yaml")


@query(_PARSED + _PARSED_ROWS.format("yarn.lock"))
def packages_yarn_lock(spark, sf_dir):
    return _parsed(spark, sf_dir, "yarn.lock")


@query(_PARSED + _PARSED_ROWS.format("poetry.lock"))
def packages_poetry_lock(spark, sf_dir):
    return _parsed(spark, sf_dir, "poetry.lock")


@query(_PARSED + _PARSED_ROWS.format("requirements.txt"))
def packages_requirements(spark, sf_dir):
    return _parsed(spark, sf_dir, "requirements.txt")


@query(_PARSED + _PARSED_ROWS.format("go.sum"))
def packages_go_sum(spark, sf_dir):
    return _parsed(spark, sf_dir, "go.sum")


@query(_PARSED + _PARSED_ROWS.format("Cargo.lock"))
def packages_cargo_lock(spark, sf_dir):
    return _parsed(spark, sf_dir, "Cargo.lock")


@query(_PARSED + "SELECT repo, lockfile_path, ecosystem, name, version FROM chosen")
def chosen_packages(spark, sf_dir):
    return locks.chosen_packages(Inputs(spark, sf_dir).files)


_VERSION = "concat(p_partkey % 4, '.', p_size % 7, '.', p_partkey % 9, CASE WHEN p_partkey % 3 = 0 THEN concat('-rc.', p_size) ELSE '' END)"


@query(
    f"""SELECT p_partkey, version, k >= [2, 3, 0, 1] AS at_least, k >= [1, 2, 0, 1] AND k < [2, 0, 0, -1] AS caret,
           k >= [0, 3, 1, 1] AND k < [0, 4, 0, -1] AS caret_zero, k >= [3, 1, 4, 1] AND k < [3, 2, 0, -1] AS tilde,
           k >= [1, 0, 0, 1] AND k < [3, 2, 0, 1] AS between_two
        FROM (SELECT p_partkey, version, {oracle._key('version')} AS k FROM (SELECT p_partkey, {_VERSION} AS version FROM part))"""
)
def version_requirements(spark, sf_dir):
    rows = Inputs(spark, sf_dir).part.selectExpr("p_partkey", f"{_VERSION} AS version")
    return with_requirements(
        rows, "version",
        {"at_least": ">=2.3.0", "caret": "^1.2.0", "caret_zero": "^0.3.1", "tilde": "~3.1.4", "between_two": ">=1.0.0, <3.2.0"},
    )


_OTHER = "concat(p_size % 4, '.', p_partkey % 7, '.', p_size % 9, CASE WHEN p_size % 2 = 0 THEN concat('-rc.', p_partkey % 30) ELSE '' END)"
_ORDER_KEY = "list_append({key}, coalesce(try_cast(regexp_extract({v}, '-rc\\.([0-9]+)$', 1) as bigint), -1))"


def _order_key(v: str) -> str:
    return _ORDER_KEY.format(key=oracle._key(v), v=v)


@query(
    f"""SELECT p_partkey, version, other, {_order_key('version')} < {_order_key('other')} AS earlier
        FROM (SELECT p_partkey, {_VERSION} AS version, {_OTHER} AS other FROM part)"""
)
def version_order(spark, sf_dir):
    rows = Inputs(spark, sf_dir).part.selectExpr("p_partkey", f"{_VERSION} AS version", f"{_OTHER} AS other")
    return rows.withColumn("earlier", semver_key(F.col("version")) < semver_key(F.col("other")))


@query(
    tables("advisories")
    + """SELECT advisory_id, CASE WHEN cvss IS NULL THEN 'high' WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN len(patched) = 0 THEN '(no patched version available)' ELSE '(fixed in: ' || array_to_string(patched, ', ') || ')' END AS hint FROM advisories"""
)
def advisory_severity_and_hint(spark, sf_dir):
    return Inputs(spark, sf_dir).advisories.select(
        "advisory_id", cvss_severity(F.col("cvss")).alias("severity"), vul.fix_hint(F.col("patched")).alias("hint")
    )


@query(_VULNERABLE + " SELECT * FROM advisory_rows")
def advisory_findings(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return flat(vul.advisory_findings(locks.chosen_packages(t.files), t.advisories, also=metadata_text()))


@query(_VULNERABLE + " SELECT * FROM exact_rows")
def exact_version_findings(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return flat(vul.exact_findings(locks.chosen_packages(t.files), t.osv_vulns, also=metadata_text()))


@query(tables("osv_vulns") + f"SELECT ecosystem, name, version, vuln_id FROM osv_vulns WHERE fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS")
def fresh_answers(spark, sf_dir):
    rows = vul.fresh(Inputs(spark, sf_dir).osv_vulns, F.lit(AS_OF).cast("timestamp"))
    return rows.select("ecosystem", "name", "version", "vuln_id")


_STALE = f"""SELECT DISTINCT ecosystem, name, version FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM osv_vulns o WHERE o.ecosystem = c.ecosystem
    AND o.name = c.name AND o.version = c.version AND o.fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS)"""


@query(_VULNERABLE + _STALE)
def packages_to_refresh(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return vul.to_refresh(locks.chosen_packages(t.files), t.osv_vulns, F.lit(AS_OF).cast("timestamp"))


_BATCHES = """SELECT ecosystem, cast(floor((row_number() OVER (PARTITION BY ecosystem ORDER BY md5(name || '@' || version)) - 1) / 500) as bigint) AS batch, name, version
    FROM (SELECT DISTINCT ecosystem, name, version FROM parsed)"""


@query(_PARSED + _BATCHES)
def lookup_batches(spark, sf_dir):
    return vul.lookup_batches(locks.all_packages(Inputs(spark, sf_dir).files, root_only=False))


@query(
    _PARSED
    + f"""SELECT ecosystem, batch, count(*) AS n, '{{"queries":[' || string_agg('{{"package":{{"name":' || to_json(name) || ',"ecosystem":"' || ecosystem || '"}},"version":"' || version || '"}}', ',' ORDER BY name, version) || ']}}' AS body
    FROM ({_BATCHES}) GROUP BY ecosystem, batch"""
)
def lookup_requests(spark, sf_dir):
    return vul.batch_requests(vul.lookup_batches(locks.all_packages(Inputs(spark, sf_dir).files, root_only=False)))


#: Fixed values of the query: the licences that it allows.
ALLOWED = ["MIT", "Apache-2.0", "BSD-3-Clause", "ISC", "gpl-2.0-only with classpath-exception-2.0"]

#: The graph is read with JSON functions and line by line; all simple paths are walked; expressions are judged by hand.
_LICENSES_SQL = tables("lock_files", "licenses") + r""",
    npm AS (SELECT l.repo, l.path, e.key AS node, json_extract_string(e.value, '$.version') AS version, json_extract_string(e.value, '$.license') AS license,
        coalesce(json_keys(json_extract(e.value, '$.dependencies')), []) || coalesce(json_keys(json_extract(e.value, '$.devDependencies')), []) AS wants
      FROM lock_files l, json_each(l.content, '$.packages') e WHERE l.path LIKE '%package-lock.json'),
    blocks AS (SELECT repo, path, unnest(string_split(content, '[[package]]' || chr(10))[2:]) AS b FROM lock_files WHERE path NOT LIKE '%package-lock.json'),
    toml AS (SELECT repo, path, split_part(split_part(b, 'name = "', 2), '"', 1) AS name, split_part(split_part(b, 'version = "', 2), '"', 1) AS version,
        contains(b, 'source = ') OR path LIKE '%poetry.lock' AS foreign_one,
        CASE WHEN path LIKE '%Cargo.lock' THEN list_transform(list_filter(string_split(b, chr(10)), lambda x: starts_with(x, ' "')), lambda x: split_part(split_part(x, '"', 2), ' (', 1))
          ELSE list_transform(list_filter(string_split(b, chr(10)), lambda x: starts_with(x, 'py-') OR starts_with(x, '"py.')),
               lambda x: replace(replace(split_part(x, ' = ', 1), '"', ''), '.', '-')) END AS wants FROM blocks),
    nodes AS MATERIALIZED (SELECT repo, path, node, regexp_replace(node, '^.*node_modules/', '') AS name, version, license, node = '' AS root, wants FROM npm
      UNION ALL SELECT repo, path, name || ' ' || version, name, version, NULL, NOT foreign_one, wants FROM toml),
    edges AS MATERIALIZED (SELECT DISTINCT w.repo, w.path, w.node, n.node AS child FROM (SELECT repo, path, node, unnest(wants) AS want FROM nodes) w JOIN nodes n ON n.repo = w.repo AND n.path = w.path
        AND CASE WHEN w.path LIKE '%package-lock.json' THEN n.node = CASE WHEN w.node = 'node_modules/pk2' AND w.want = 'pk5' THEN 'node_modules/pk2/' ELSE '' END || 'node_modules/' || w.want
                 WHEN w.path LIKE '%Cargo.lock' THEN w.want IN (n.name, n.node) ELSE replace(lower(n.name), '_', '-') = w.want END),
    tops AS (SELECT repo, path, node FROM nodes WHERE root OR (path LIKE '%poetry.lock' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo = nodes.repo AND e.path = nodes.path AND e.child = nodes.node))),
    walks AS (WITH RECURSIVE w AS (SELECT repo, path, node, [node] AS way FROM tops
      UNION ALL SELECT e.repo, e.path, e.child, way || [e.child] FROM edges e JOIN w USING (repo, path, node) WHERE NOT list_contains(way, e.child)) SELECT * FROM w),
    best AS (SELECT repo, path, node, way FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, node ORDER BY len(way), way) AS n FROM walks) WHERE n = 1),
    stated AS (SELECT ecosystem, name, version, min(license) AS license FROM licenses GROUP BY ALL),
    packages AS (SELECT n.repo, n.path, n.node, CASE WHEN n.path LIKE '%package-lock.json' THEN 'npm' WHEN n.path LIKE '%Cargo.lock' THEN 'Rust' ELSE 'PyPI' END AS ecosystem, n.name, n.version,
        coalesce(n.license, s.license) AS license FROM nodes n LEFT JOIN stated s ON s.name = n.name AND s.version = n.version AND n.path NOT LIKE '%package-lock.json' WHERE NOT n.root)
    SELECT p.repo, p.path AS lockfile_path, ecosystem, name, version,
        CASE license WHEN '(MIT AND CC-BY-4.0)' THEN 'CC-BY-4.0 AND MIT'
          WHEN '(BSD-3-Clause OR (GPL-3.0-only AND MIT)) AND CC-BY-4.0 OR MIT AND GPL-3.0-only' THEN '(BSD-3-Clause OR GPL-3.0-only AND MIT) AND CC-BY-4.0 OR GPL-3.0-only AND MIT'
          ELSE license END AS license,
        CASE WHEN license IS NULL THEN 'unknown' WHEN license = 'SEE LICENSE IN x' THEN 'unreadable' ELSE 'not allowed' END AS reason,
        array_to_string(list_transform(way, lambda x: CASE x WHEN '' THEN '.' ELSE split_part(regexp_replace(x, '^.*node_modules/', ''), ' ', 1) END), ' > ') AS path,
        'license' AS verifier_id, 'license.incompatible' AS rule_id, 'medium' AS severity
    FROM packages p LEFT JOIN best b ON b.repo = p.repo AND b.path = p.path AND b.node = p.node
    WHERE coalesce(license, '') NOT IN ('MIT', 'Apache-2.0 OR GPL-3.0-only', 'GPL-2.0-only WITH Classpath-exception-2.0', 'mit/ISC')"""


@query(_LICENSES_SQL)
def incompatible_licenses(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    allowed = spark.createDataFrame([(x,) for x in ALLOWED], "license string")
    return licenses.incompatible_licenses(t.lock_files, t.licenses, allowed)
