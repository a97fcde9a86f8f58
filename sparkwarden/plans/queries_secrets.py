"""Queries on secret detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import text as tx
from sparkwarden.operators import promptleak
from sparkwarden.operators import secrets as sec
from sparkwarden.operators.findings import counts_by_severity, for_languages
from sparkwarden.plans import oracle
from sparkwarden.plans.oracle import entropy, line_of, place, preview, tables
from sparkwarden.plans.registry import Inputs, flat, query
from sparkwarden.session import stored
from sparkwarden.sources.rules import CRITICAL_MARKERS, MEDIUM_MARKERS, STARTER_RULES, SecretRule, load_rules, rule_severity

OPTIONS = sec.SecretOptions(unicode=False)
_CODE = "code AS MATERIALIZED (SELECT * FROM files WHERE language IN ('rust', 'typescript', 'javascript', 'python'))"
CODE = tables("files") + ", " + _CODE
FLAT = """repo, 'secrets' AS verifier_id, rule_id, severity, message, path, start_line, start_col, end_line, end_col, snippet,
    cast(NULL as double) AS provenance_score, metadata"""


def code(spark, sf_dir):
    return for_languages(Inputs(spark, sf_dir).files, sec.LANGUAGES)


_RULE_IDS = "concat(CASE p_partkey % 6 WHEN 0 THEN 'github-pat' WHEN 1 THEN 'x-trello' WHEN 2 THEN 'jwt' WHEN 3 THEN 'my-private-key' WHEN 4 THEN 'sentry-vault-batch-token' ELSE 'npm' END, '-', p_size)"


@query(
    f"""SELECT p_partkey, rule_id, CASE WHEN {' OR '.join(f"contains(rule_id, '{m}')" for m in CRITICAL_MARKERS)} THEN 'critical'
        WHEN {' OR '.join(f"contains(rule_id, '{m}')" for m in MEDIUM_MARKERS)} THEN 'medium' ELSE 'high' END AS severity
        FROM (SELECT p_partkey, {_RULE_IDS} AS rule_id FROM part)"""
)
def rule_severities(spark, sf_dir):
    rows = Inputs(spark, sf_dir).part.selectExpr("p_partkey", f"{_RULE_IDS} AS rule_id")
    return rows.select("p_partkey", "rule_id", rule_severity(F.col("rule_id")).alias("severity"))


@query(
    CODE + f""", m AS ({oracle.rule_match_rows('code')})
    SELECT repo, path, rule AS rule_id, length(before) AS start, length(before) + length(text) AS "end", {place()}, text,
           round({entropy('text')}, 6) AS entropy FROM m"""
)
def rule_matches(spark, sf_dir):
    return sec.rule_matches(code(spark, sf_dir), OPTIONS).withColumn("entropy", F.round("entropy", 6))


@query(
    tables("text_files")
    + " UNION ALL ".join(
        f"SELECT '{r.rule_id}' AS rule_id, count(*) AS n FROM text_files WHERE "
        + " OR ".join(
            f"contains(content, '{k}')" if r.exact_keywords else f"contains(lower(content), '{k}')" for k in r.keywords
        )
        for r in STARTER_RULES
    )
)
def keyword_candidates(spark, sf_dir):
    text = F.col("content")
    folded = F.lower(F.replace(text, F.lit("ſ"), F.lit("s")))
    counts = []
    for rule in STARTER_RULES:
        seen = F.lit(False)
        for k in rule.keywords:
            seen = seen | (F.contains(text, F.lit(k)) if rule.exact_keywords else F.contains(folded, F.lit(k)))
        counts.append(F.count_if(seen).alias(rule.rule_id))
    wide = Inputs(spark, sf_dir).text_files.agg(*counts)
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"`{r.rule_id}`").alias("n")) for r in STARTER_RULES]))
    )


@query(f"SELECT doc_id, round({entropy('text')}, 6) AS bits FROM documents")
def document_entropy(spark, sf_dir):
    docs = Inputs(spark, sf_dir).documents
    return docs.select("doc_id", F.round(tx.shannon_entropy(F.col("text")), 6).alias("bits"))


@query(
    CODE + f""", m AS ({oracle.rule_match_rows('code')}) SELECT repo, path, rule AS rule_id, {line_of('before')} AS start_line, text FROM m
    WHERE floor IS NULL OR round({entropy('text')}, 6) >= floor"""
)
def entropy_gate(spark, sf_dir):
    floors = F.create_map(*[x for r in STARTER_RULES for x in (F.lit(r.rule_id), F.lit(r.entropy).cast("double"))])
    rows = sec.rule_matches(code(spark, sf_dir), OPTIONS).withColumn("floor", F.element_at(floors, F.col("rule_id")))
    kept = rows.where(F.col("floor").isNull() | (F.round("entropy", 6) >= F.col("floor")))
    return kept.select("repo", "path", "rule_id", "start_line", "text")


@query(CODE + f", tokens AS ({oracle.token_rows('code')}) SELECT repo, path, language, kind, s AS start, e AS \"end\", {place()}, text FROM tokens")
def token_spans(spark, sf_dir):
    return sec.tokens(code(spark, sf_dir))


@query(
    CODE + f""", m AS MATERIALIZED ({oracle.rule_match_rows('code')}), tokens AS MATERIALIZED ({oracle.token_rows('code')})
    SELECT m.repo, m.path, m.rule AS rule_id, length(m.before) AS start,
           coalesce(any_value(CASE WHEN t.kind = 'comment' THEN 'comment' WHEN t.kind IS NOT NULL THEN 'string' END), 'code') AS context
    FROM m LEFT JOIN tokens t ON t.repo = m.repo AND t.path = m.path AND length(m.before) >= t.s AND length(m.before) < t.e
    GROUP BY ALL"""
)
def match_context(spark, sf_dir):
    return sec.match_context(code(spark, sf_dir), OPTIONS)


@query(tables("files") + oracle.marker_rows("files"))
def allow_markers(spark, sf_dir):
    return sec.allow_markers(Inputs(spark, sf_dir).files)


@query(
    CODE + f""", m AS MATERIALIZED ({oracle.rule_match_rows('code')}), k AS MATERIALIZED ({oracle.marker_rows('code')})
    SELECT m.repo, m.path, m.rule AS rule_id, {line_of('m.before')} AS start_line, m.text FROM m
    WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.repo = m.repo AND k.path = m.path AND k.line = {line_of('m.before')}
                      AND contains(m.rule, k.rule_part))"""
)
def unallowed_matches(spark, sf_dir):
    files = code(spark, sf_dir)
    kept = sec.drop_allowed(sec.rule_matches(files, OPTIONS), sec.allow_markers(files))
    return kept.select("repo", "path", "rule_id", "start_line", "text")


@query(
    f"""SELECT doc_id, {line_of('b')} AS line, {oracle.col_of('b')} AS col
        FROM (SELECT doc_id, substr(text, 1, cast(floor(length(text) / 2) as bigint)) AS b FROM documents)"""
)
def offset_to_line_col(spark, sf_dir):
    docs = Inputs(spark, sf_dir).documents
    half = F.floor(F.length("text") / 2).cast("int")
    return docs.select("doc_id", tx.line_col(F.col("text"), half).alias("p")).select("doc_id", "p.line", "p.col")


@query(f"SELECT doc_id, {preview('text')} AS preview FROM documents")
def text_preview(spark, sf_dir):
    return Inputs(spark, sf_dir).documents.select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query(CODE + f", tokens AS ({oracle.token_rows('code')}) SELECT repo, path, s AS start, text FROM tokens WHERE kind = 'string'")
def string_literals(spark, sf_dir):
    return sec.string_literals(code(spark, sf_dir)).select("repo", "path", "start", "text")


@query(CODE + "," + oracle.secret_ctes("code") + f"SELECT {FLAT} FROM secret_rows WHERE rule_id = 'secrets.generic-high-entropy'")
def high_entropy_literals(spark, sf_dir):
    return flat(sec.secret_findings(code(spark, sf_dir), sec.SecretOptions(rules=[], unicode=False)))


@query(CODE + "," + oracle.secret_ctes("code") + f"SELECT {FLAT} FROM secret_rows")
def secret_findings(spark, sf_dir):
    return flat(sec.secret_findings(code(spark, sf_dir), OPTIONS))


@query(CODE + "," + oracle.secret_ctes("code") + f"SELECT {FLAT} FROM (SELECT DISTINCT * FROM secret_rows)")
def deduplicated_findings(spark, sf_dir):
    # Written once: both copies come from one scan of the text.
    found = stored(sec.secret_findings(code(spark, sf_dir), OPTIONS))
    return flat(sec.dedupe_findings(found.unionAll(found)))


_TEXTS = "texts AS MATERIALIZED (SELECT * FROM text_files UNION ALL SELECT * FROM page_files)"


@query(tables("text_files", "page_files") + f", {_TEXTS}, " + oracle.secret_ctes("texts") + f"SELECT {FLAT} FROM secret_rows")
def secrets_in_texts(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return flat(sec.secret_findings(t.text_files.unionByName(t.page_files), OPTIONS))


@query(
    tables("text_files", "page_files") + f", {_TEXTS}, " + oracle.secret_ctes("texts")
    + "SELECT repo, "
    + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))
    + " FROM secret_rows GROUP BY repo"
)
def secrets_by_severity(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return counts_by_severity(sec.secret_findings(t.text_files.unionByName(t.page_files), OPTIONS))


_WS = "len(regexp_extract_all(text, '[ \\t\\n\\r\\f]'))"


@query(
    f"""SELECT doc_id, cast((strlen(text) - strlen(replace(text, 'on', ''))) / 2 as int) AS n_on,
        len(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10))) AS n_lines,
        md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lower_md5,
        round({_WS} / strlen(text), 6) AS ws_ratio, n_chars % 100 BETWEEN 10 AND 19 OR n_chars % 100 BETWEEN 30 AND 34 AS in_ranges
        FROM documents"""
)
def text_measures(spark, sf_dir):
    text = F.col("text")
    ranges = F.expr("array(struct(10 AS start, 20 AS end), struct(30 AS start, 35 AS end))")
    return Inputs(spark, sf_dir).documents.select(
        "doc_id",
        tx.count_literal(text, F.lit("on")).alias("n_on"),
        F.size(tx.lines(text)).alias("n_lines"),
        F.md5(tx.ascii_lower(text).cast("binary")).alias("lower_md5"),
        F.round(tx.ascii_ws_ratio(text), 6).alias("ws_ratio"),
        tx.in_ranges(F.col("n_chars") % 100, ranges).alias("in_ranges"),
    )


def _own_rules(n: int) -> list[SecretRule]:
    """Rules of a large rule file: with one literal, with alternatives, in any case, with digits only, and for what is nowhere."""
    rules = []
    for i in range(n):
        regex = [
            rf"Name{i % 10}\('{i // 5 % 10}'\)", rf"(?i)MOD{i % 7}::name{i % 6}", rf"\b(?:helper|mod){i}\b", rf"[A-F]{{2,6}}{i:03d}[0-9A-F]{{5}}",
            rf"gh{'p' if i == 4 else i}_[0-9a-f]{{{8 + i % 20}}}",
        ][i % 5]
        rules.append(SecretRule(f"own-{'trello' if i % 3 else 'vault-batch-token'}-{i}", f"Own rule {i}", regex, 3.0 if i % 7 == 0 else None, (f"name{i}",)))
    return rules


def _rule_file(rules: list[SecretRule]) -> str:
    out = ["title = 'own rules'"]
    for r in rules:
        entropy = "" if r.entropy is None else f"entropy = {r.entropy}\n"
        words = ", ".join(f'"{k}"' for k in r.keywords)
        out.append(f"[[rules]]\nid = '{r.rule_id}'\ndescription = '{r.description}'\nregex = \'\'\'{r.regex}\'\'\'\n{entropy}keywords = [{words}]")
    return "\n\n".join([*out, "[[rules]]\nid = 'path-only'\npath = 'x'", "[[rules]]\nid = 'broken'\nregex = '(['"])


_OWN = _own_rules(200)


@query(CODE + "," + oracle.secret_ctes("code", rules=_OWN) + f"SELECT {FLAT} FROM secret_rows WHERE rule_id <> 'secrets.generic-high-entropy'")
def loaded_rule_findings(spark, sf_dir):
    """The rules of a rule file with 200 usable entries."""
    rules, _ = load_rules(spark, _rule_file(_OWN))
    return flat(sec.secret_findings(code(spark, sf_dir), sec.SecretOptions(rules=rules, unicode=False, literals=False)))


@query(tables("text_files") + f"SELECT repo, path, rule AS rule_id, length(before) AS start, text FROM ({oracle.rule_match_rows('text_files')})")
def rule_matches_unicode(spark, sf_dir):
    """Rules in their default mode, in which word and space classes cover Unicode, on texts in several languages."""
    return sec.rule_matches(Inputs(spark, sf_dir).text_files, sec.SecretOptions()).select("repo", "path", "rule_id", "start", "text")


def _grams(source: str, keys: str, text: str, size: int) -> str:
    """All passages of a size, cut from pieces of the text's letters and digits."""
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""SELECT {keys}, base + i AS i, substr(piece, i::BIGINT, {size}) AS gram FROM (
        SELECT *, unnest(range(1, length(piece) - {size} + 2)) AS i FROM (
          SELECT {keys}, base, substr(s, base + 1, 1000 + {size} - 1) AS piece FROM (
            SELECT *, unnest(range(0, length(s), 1000)) AS base FROM (
              SELECT {keys}, regexp_replace({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '', 'g') AS s FROM {source}))))"""


@query(
    tables("text_files") + rf""",
    g AS ({_grams('text_files', 'repo, path', 'content', promptleak.GUARANTEE)}), b AS ({_grams('benchmark', 'item_id', 'text', promptleak.GUARANTEE)}),
    hits AS (SELECT DISTINCT repo, path, item_id AS prompt_id, g.i FROM g JOIN b USING (gram)),
    runs AS (SELECT *, sum(CASE WHEN i - before <= {promptleak.GUARANTEE} THEN 0 ELSE 1 END) OVER (PARTITION BY repo, path, prompt_id ORDER BY i) AS run
      FROM (SELECT *, lag(i) OVER (PARTITION BY repo, path, prompt_id ORDER BY i) AS before FROM hits))
    SELECT repo, path, prompt_id, (min(i) - 1)::INT AS norm_start, (max(i) - min(i) + {promptleak.GUARANTEE})::INT AS length FROM runs GROUP BY repo, path, prompt_id, run"""
)
def prompt_leaks(spark, sf_dir):
    """Passages of the benchmark, as prompts, in all documents, as files."""
    t = Inputs(spark, sf_dir)
    prompts = t.benchmark.select(F.col("item_id").alias("prompt_id"), "text")
    return promptleak.prompt_leaks(t.text_files, prompts).select("repo", "path", "prompt_id", "norm_start", "length")
