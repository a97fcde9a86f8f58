"""Secret detection over a files table.

All steps are expressions on one file row: nothing is shuffled, and the file text never leaves the stage
that reads it. Positions are worked out only for files with a match.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.functions.arrays import count_at_most, let
from sparkwarden.functions.literals import any_of, fold, literals_in, required_literals
from sparkwarden.functions.text import (
    ascii_ws_ratio,
    pieces,
    preview,
    readable,
    shannon_entropy,
    spans_of,
    strip,
)
from sparkwarden.schemas import FINDING_ITEM, FIX
from sparkwarden.sources.rules import STARTER_RULES, SecretRule, java_regex

VERIFIER = "secrets"
DESCRIPTION = "Hard-coded secrets found by token rules, string context and byte entropy"
LANGUAGES = ["rust", "typescript", "javascript", "python"]

# Comment and string tokens, leftmost first. Possessive loops keep long literals off the Java stack.
_DQ = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"'
_DQ_LINE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
_SQ_LINE = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_BACKTICK = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
_C_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
_RUST = (
    _C_COMMENT + r'|b?r"[^"]*"|b?r#"(?s:.*?)"#|b?r##"(?s:.*?)"##|b?' + _DQ + r"|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'"
)
_SCRIPT = "|".join([_C_COMMENT, _DQ_LINE, _SQ_LINE, _BACKTICK])
_PYTHON = r'#[^\n]*|[rRbBuUfF]{0,2}(?:"""(?s:.*?)"""|' + r"'''(?s:.*?)'''|" + _DQ_LINE + "|" + _SQ_LINE + ")"
TOKEN_PATTERNS = {"rust": _RUST, "typescript": _SCRIPT, "javascript": _SCRIPT, "python": _PYTHON}

_QUOTES = "[\"'`]+"

# Numbers that stand for tokens and allow markers next to the rule numbers.
_TOKENS, _MARKERS = -1, -2


@dataclass(frozen=True)
class SecretOptions:
    """What to look for. ``allowlist`` drops findings whose rule id contains one of its entries.

    With ``find_literals`` a file is searched once for the literals that the rules' regexes need, and by regex only for rules
    whose literals are there; rules without such a literal always run. The findings are the same.
    """

    rules: Sequence[SecretRule] = field(default_factory=lambda: STARTER_RULES)
    prefix: str = "audit"
    literals: bool = True
    literal_min_bytes: int = 20
    literal_min_entropy: float = 4.5
    literal_max_space: float = 0.08
    allowlist: Sequence[str] = ()
    unicode: bool = True
    find_literals: bool = True

    def needed(self) -> dict[int, frozenset[str]]:
        """Required literals by the number of the rule, for rules whose keywords are no such test already."""
        if not self.find_literals:
            return {}
        found = {n: required_literals(r.regex) for n, r in enumerate(self.rules) if not (r.prefilter and r.keywords)}
        return {n: words for n, words in found.items() if words}


# --- building blocks --------------------------------------------------------------------------------

def token_pieces(text: Column, language: Column) -> Column:
    """``pieces`` output for comment and string tokens; null for languages without token patterns."""
    out = None
    for pattern in dict.fromkeys(TOKEN_PATTERNS.values()):
        names = [name for name, own in TOKEN_PATTERNS.items() if own == pattern]
        out = (F if out is None else out).when(language.isin(names), pieces(text, pattern))
    return out


def token_kind(token: Column, language: Column) -> Column:
    """``comment``, ``char`` (Rust character literals, string context only) or ``string``."""
    comment = F.when(language == "python", F.startswith(token, F.lit("#"))).otherwise(
        F.startswith(token, F.lit("//")) | F.startswith(token, F.lit("/*"))
    )
    char = (language == "rust") & F.rlike(token, F.lit("^b?'"))
    return F.when(comment, F.lit("comment")).when(char, F.lit("char")).otherwise(F.lit("string"))


_GAP = r"[^\S\n]"
_ALLOWED = r"secrets(?:\.[a-zA-Z0-9_.-]+)?"


def marker_pieces(text: Column, prefix: str) -> Column:
    """``pieces`` output for allow markers; null for texts without one."""
    pattern = f"(?U:{re.escape(prefix)}:allow{_GAP}+{_ALLOWED}(?:{_GAP}*,{_GAP}*{_ALLOWED})*)"
    return F.when(F.contains(text, F.lit(f"{prefix}:allow")), pieces(text, pattern))


def markers_of(spans: Column, prefix: str) -> Column:
    """Allow markers, the first of each line: ``array<struct<line, ids>>``; id "" allows every rule."""

    def ids(marker: Column) -> Column:
        listed = F.regexp_replace(marker, F.lit(rf"(?U)^{re.escape(prefix)}:allow\s+"), F.lit(""))
        return F.transform(
            F.split(listed, ","),
            lambda name: F.regexp_replace(strip(name), F.lit(r"^secrets\.?"), F.lit("")),
        )

    def firsts(found: Column) -> Column:
        kept = F.filter(
            found,
            lambda s, i: (i == 0) | (s["start_line"] != F.get(found, i - 1)["start_line"]),
        )
        return F.transform(kept, lambda s: F.struct(s["start_line"].alias("line"), ids(s["text"]).alias("ids")))

    return let(spans, firsts)


def is_allowed(markers: Column, line: Column, rule_id: Column) -> Column:
    """True if the line carries a marker with an id that is part of the rule id."""
    at = F.get(markers, F.array_position(F.transform(markers, lambda m: m["line"]), line).cast("int") - 1)
    return markers.isNotNull() & F.coalesce(
        F.exists(at["ids"], lambda name: F.contains(rule_id, name)), F.lit(False)
    )


def rule_hits(text: Column, folded: Column, found: Column, options: SecretOptions) -> Column:
    """One flag per rule: does it match somewhere? Where a rule allows it, cheap tests of keywords or literals come before the regex."""
    tests, literals = [], options.needed()
    words = sorted(set().union(*literals.values()))
    for number, rule in enumerate(options.rules):
        hit = F.rlike(text, F.lit(java_regex(rule.regex, options.unicode)))
        if rule.prefilter and rule.keywords:
            seen = [
                F.contains(text, F.lit(k)) if rule.exact_keywords else F.contains(folded, F.lit(k.lower()))
                for k in rule.keywords
            ]
            any_seen = seen[0]
            for other in seen[1:]:
                any_seen = any_seen | other
            hit = any_seen & hit
        elif number in literals:
            hit = any_of(found, literals[number], words) & hit
        tests.append(hit)
    return F.array(*tests) if tests else F.expr("cast(array() as array<boolean>)")


def _needs_folding(options: SecretOptions) -> bool:
    return any(r.prefilter and r.keywords and not r.exact_keywords for r in options.rules)


def rule_pieces(text: Column, hits: Column, options: SecretOptions) -> list[Column]:
    """One ``struct<rule, parts>`` per rule, null where the rule does not match."""
    return [
        F.when(
            F.get(hits, F.lit(number)),
            F.struct(F.lit(number).alias("rule"), pieces(text, java_regex(rule.regex, options.unicode)).alias("parts")),
        )
        for number, rule in enumerate(options.rules)
    ]


def _located(lists: Column) -> Column:
    """Spans for a list of ``struct<rule, parts>``; one expression serves rules, tokens and markers."""
    return F.transform(lists, lambda x: F.struct(x["rule"].alias("rule"), spans_of(x["parts"]).alias("spans")))


def _rule_spans(located: Column) -> Column:
    return F.flatten(
        F.transform(
            located,
            lambda x: F.transform(x["spans"], lambda s: F.struct(x["rule"].alias("rule"), s.alias("at"))),
        )
    )


def literal_candidates(parts: Column, language: Column, options: SecretOptions) -> Column:
    """String tokens that look like credentials: ``array<struct<place, cleaned, entropy>>``."""

    def judge(token: Column, place: Column) -> Column:
        cleaned = F.regexp_replace(
            F.regexp_replace(token, F.lit(f"^{_QUOTES}"), F.lit("")), F.lit(f"{_QUOTES}$"), F.lit("")
        )
        return F.struct(place.alias("place"), cleaned.alias("cleaned"))

    def plausible(c: Column) -> Column:
        text = c["cleaned"]
        prose = F.contains(text, F.lit(". ")) | F.contains(text, F.lit(", ")) | F.contains(text, F.lit("; "))
        return (F.octet_length(text) >= options.literal_min_bytes) & (ascii_ws_ratio(text) <= options.literal_max_space) & ~prose

    long_tokens = F.filter(
        F.transform(parts, lambda p, i: F.struct(p.alias("token"), i.alias("place"))),
        lambda t: (t["place"] % 2 == 1)
        & (F.octet_length(t["token"]) >= options.literal_min_bytes)
        & (token_kind(t["token"], language) == "string"),
    )
    cleaned = F.filter(F.transform(long_tokens, lambda t: judge(t["token"], t["place"])), plausible)
    # Most files have no long token at all; one cheap test per piece settles that.
    any_long = F.exists(
        parts,
        lambda p: (F.octet_length(p) >= options.literal_min_bytes) & F.rlike(p, F.lit(f"^[A-Za-z]{{0,2}}#{{0,2}}{_QUOTES}")),
    )
    cleaned = F.when(any_long, cleaned).otherwise(F.expr("cast(array() as array<struct<place:int,cleaned:string>>)"))
    scored = F.transform(
        cleaned,
        lambda c: F.struct(
            c["place"].alias("place"), c["cleaned"].alias("cleaned"), shannon_entropy(c["cleaned"]).alias("entropy")
        ),
    )
    return F.filter(scored, lambda c: F.round(c["entropy"], 6) >= options.literal_min_entropy)


# --- the scan ---------------------------------------------------------------------------------------

def _scan_input(files: DataFrame, options: SecretOptions, keep: Sequence[str]) -> DataFrame:
    text = files.select(*keep, "language", readable(F.col("content")).alias("text"))
    # Lower case alone misses the long s, which a case-insensitive regex takes for an s.
    folded = F.lower(F.replace(F.col("text"), F.lit("ſ"), F.lit("s"))) if _needs_folding(options) else F.lit("")
    literals = options.needed()
    found = literals_in(fold(F.col("text")), sorted(set().union(*literals.values()))) if literals else F.lit(None)
    return text.select("*", folded.alias("folded"), found.alias("found")).select(
        *keep,
        "language",
        "text",
        rule_hits(F.col("text"), F.col("folded"), F.col("found"), options).alias("hits"),
        token_pieces(F.col("text"), F.col("language")).alias("parts"),
    )


def _findings_expr(options: SecretOptions) -> Column:
    text, hits, parts, language = F.col("text"), F.col("hits"), F.col("parts"), F.col("language")
    rules = list(options.rules)
    ids = F.array(*[F.lit(r.rule_id) for r in rules]).cast("array<string>")
    descriptions = F.array(*[F.lit(r.description) for r in rules]).cast("array<string>")
    severities = F.array(*[F.lit(r.severity) for r in rules]).cast("array<string>")
    floors = F.array(*[F.lit(r.entropy).cast("double") for r in rules]).cast("array<double>")
    none = F.expr(f"cast(array() as array<{FINDING_ITEM}>)")

    def allowed_by_option(rule_id: Column) -> Column:
        dropped = F.lit(False)
        for part in options.allowlist:
            dropped = dropped | F.contains(rule_id, F.lit(part))
        return dropped

    def in_comment(tokens: Column, start: Column) -> Column:
        # tokens: sorted starts, ends and comment flags of the file's tokens; null without context.
        return F.coalesce(
            let(
                count_at_most(tokens["starts"], start) - 1,
                lambda k: (k >= 0) & (start < F.get(tokens["ends"], k)) & F.get(tokens["comments"], k),
            ),
            F.lit(False),
        )

    def item(rule_id, severity, message, at, snippet, metadata) -> Column:
        return F.struct(
            F.lit(VERIFIER).alias("verifier_id"),
            F.concat(F.lit("secrets."), rule_id).alias("rule_id"),
            severity.alias("severity"),
            message.alias("message"),
            *[at[name].alias(name) for name in ("start_line", "start_col", "end_line", "end_col")],
            snippet.alias("snippet"),
            metadata.alias("metadata"),
        )

    def rule_findings(found: Column, tokens: Column, markers: Column) -> Column:
        kept = F.filter(
            found,
            lambda m: ~is_allowed(markers, m["at"]["start_line"], F.get(ids, m["rule"]))
            & ~allowed_by_option(F.get(ids, m["rule"]))
            & (
                F.get(floors, m["rule"]).isNull()
                | (F.round(shannon_entropy(m["at"]["text"]), 6) >= F.get(floors, m["rule"]))
            )
            & ~in_comment(tokens, m["at"]["start"]),
        )
        return F.transform(
            kept,
            lambda m: let(
                preview(m["at"]["text"]),
                lambda short: item(
                    F.get(ids, m["rule"]),
                    F.get(severities, m["rule"]),
                    F.concat(F.get(descriptions, m["rule"]), F.lit(" ("), short, F.lit(")")),
                    m["at"],
                    short,
                    F.lit(None).cast("map<string,string>"),
                ),
            ),
        )

    def literal_findings(candidates: Column, token_spans: Column, markers: Column) -> Column:
        rule = F.lit("generic-high-entropy")
        # The token at piece 1, 3, 5, ... is span 0, 1, 2, ...
        placed = F.transform(
            candidates, lambda c: F.struct(c.alias("c"), F.get(token_spans, F.floor(c["place"] / 2).cast("int")).alias("at"))
        )
        kept = F.filter(placed, lambda x: ~is_allowed(markers, x["at"]["start_line"], rule) & ~allowed_by_option(rule))
        return F.transform(
            kept,
            lambda x: item(
                rule,
                F.lit("medium"),
                F.format_string(
                    "High-entropy string literal (%.1f bits); may be a hardcoded credential", x["c"]["entropy"]
                ),
                x["at"],
                preview(x["c"]["cleaned"]),
                F.create_map(F.lit("entropy"), F.round(x["c"]["entropy"], 6).cast("string")),
            ),
        )

    def token_table(spans: Column) -> Column:
        return F.struct(
            F.transform(spans, lambda t: t["start"]).alias("starts"),
            F.transform(spans, lambda t: t["end"]).alias("ends"),
            F.transform(spans, lambda t: token_kind(t["text"], language) == "comment").alias("comments"),
        )

    def spans_named(located: Column, number: int) -> Column:
        return F.get(F.filter(located, lambda x: x["rule"] == number), F.lit(0))["spans"]

    def combine(candidates: Column, located: Column) -> Column:
        found = _rule_spans(F.filter(located, lambda x: x["rule"] >= 0))
        return let(spans_named(located, _TOKENS), lambda spans: let(
            F.when(some_hit & spans.isNotNull(), token_table(spans)),
            lambda table: let(
                markers_of(spans_named(located, _MARKERS), options.prefix),
                lambda marks: F.concat(
                    rule_findings(found, table, marks), literal_findings(candidates, spans, marks)
                ),
            ),
        ))

    some_hit = F.array_contains(hits, True)
    no_candidates = F.expr("cast(array() as array<struct<place:int,cleaned:string,entropy:double>>)")
    candidates = (
        F.coalesce(F.when(parts.isNotNull(), literal_candidates(parts, language, options)), no_candidates)
        if options.literals
        else no_candidates
    )
    marks = marker_pieces(text, options.prefix)
    lists = F.array_compact(
        F.array(
            F.when(parts.isNotNull(), F.struct(F.lit(_TOKENS).alias("rule"), parts.alias("parts"))),
            F.when(marks.isNotNull(), F.struct(F.lit(_MARKERS).alias("rule"), marks.alias("parts"))),
            *rule_pieces(text, hits, options),
        )
    )
    return F.coalesce(
        let(
            candidates,
            lambda c: F.when(some_hit | (F.size(c) > 0), let(_located(lists), lambda located: combine(c, located))),
        ),
        none,
    )


def scan_secrets(files: DataFrame, options: SecretOptions | None = None, keep: Sequence[str] = ("repo", "path")) -> DataFrame:
    """Each file row with its findings in one ``secrets`` array column; no shuffle, one pass over the text.

    ``keep`` names the other columns to carry along. Language selection is up to the caller: files of
    other languages are searched by rule only, without context and without the literal test.
    """
    options = options or SecretOptions()
    return _scan_input(files, options, keep).select(*keep, _findings_expr(options).alias("secrets"))


def explode_items(scanned: DataFrame, column: str, keep: Sequence[str] = ("repo", "path")) -> DataFrame:
    """One row per finding of an array column, in the findings schema without a score.

    The outer explode is on purpose: with a plain one the optimizer adds a size test on the array and
    pushes it down to the scan, which would run the whole scan twice.
    """
    items = scanned.select(*keep, F.explode_outer(column).alias("f")).where(F.col("f").isNotNull())
    extra = [name for name in keep if name not in ("repo", "path", "provenance_score")]
    score = F.col("provenance_score") if "provenance_score" in keep else F.lit(None).cast("double")
    return items.select(
        "repo",
        "f.verifier_id",
        "f.rule_id",
        "f.severity",
        "f.message",
        F.struct(
            "path", "f.start_line", "f.start_col", "f.end_line", "f.end_col", "f.snippet"
        ).alias("location"),
        F.lit(None).cast(FIX).alias("fix"),
        score.alias("provenance_score"),
        "f.metadata",
        *extra,
    )


def secret_findings(files: DataFrame, options: SecretOptions | None = None) -> DataFrame:
    """Findings of the secrets verifier. Files should already be limited to the wanted languages."""
    options = options or SecretOptions()
    found = explode_items(scan_secrets(files, options), "secrets")
    ids = [r.rule_id for r in options.rules]
    # Matches of one rule never start at the same place, so only rules that share an id can collide.
    return found if len(set(ids)) == len(ids) else dedupe_findings(found)


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per repo, file, rule and start position."""
    return (
        findings.withColumns({"_path": F.col("location.path"), "_l": F.col("location.start_line"), "_c": F.col("location.start_col")})
        .dropDuplicates(["repo", "_path", "rule_id", "_l", "_c"])
        .drop("_path", "_l", "_c")
    )


# --- the steps as tables ----------------------------------------------------------------------------

def rule_matches(files: DataFrame, options: SecretOptions | None = None) -> DataFrame:
    """Every match of every rule with position and entropy, before any filter."""
    options = options or SecretOptions()
    rules = list(options.rules)
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    lists = F.array_compact(F.array(*rule_pieces(F.col("text"), F.col("hits"), options)))
    spans = F.when(F.array_contains("hits", True), _rule_spans(_located(lists)))
    rows = _scan_input(files, options, ("repo", "path")).select("repo", "path", F.explode_outer(spans).alias("m"))
    return rows.where(F.col("m").isNotNull()).select(
        "repo",
        "path",
        F.get(ids, F.col("m.rule")).alias("rule_id"),
        "m.at.*",
        shannon_entropy(F.col("m.at.text")).alias("entropy"),
    )


def tokens(files: DataFrame) -> DataFrame:
    """Comment and string tokens with kind and position."""
    text = files.select("repo", "path", "language", readable(F.col("content")).alias("text"))
    parts = text.select("repo", "path", "language", token_pieces(F.col("text"), F.col("language")).alias("parts"))
    rows = parts.select("repo", "path", "language", F.explode_outer(spans_of(F.col("parts"))).alias("t"))
    return rows.where(F.col("t").isNotNull()).select(
        "repo",
        "path",
        "language",
        token_kind(F.col("t.text"), F.col("language")).alias("kind"),
        *[F.col(f"t.{name}").alias(name) for name in ("start", "end", "start_line", "start_col", "end_line", "end_col", "text")],
    )


def match_context(files: DataFrame, options: SecretOptions | None = None) -> DataFrame:
    """Rule matches with the context of their start: ``string``, ``comment``, ``code``, or null without context.

    Matches of a file meet its tokens in an equi join with the span test as residual. The scan itself
    looks tokens up inside the row; this table is for looking at the steps.
    """
    m = rule_matches(files, options).select("repo", "path", "rule_id", "start")
    t = tokens(files).select("repo", "path", "kind", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    known = files.select("repo", "path", F.col("language").isin(list(TOKEN_PATTERNS)).alias("known"))
    inside = (F.col("start") >= F.col("t_start")) & (F.col("start") < F.col("t_end"))
    # Tokens never overlap, so a match start meets at most one.
    joined = m.alias("m").join(
        t.alias("t"), (F.col("m.repo") == F.col("t.repo")) & (F.col("m.path") == F.col("t.path")) & inside, "left"
    ).select("m.repo", "m.path", "rule_id", "start", "kind")
    kind = F.when(F.col("kind") == "comment", F.lit("comment")).when(F.col("kind").isNotNull(), F.lit("string"))
    return joined.join(known, ["repo", "path"]).select(
        "repo", "path", "rule_id", "start", F.when(F.col("known"), F.coalesce(kind, F.lit("code"))).alias("context")
    )


def string_literals(files: DataFrame) -> DataFrame:
    """String literals; Rust character literals are not strings here."""
    return tokens(files).where(F.col("kind") == "string").drop("kind")


def allow_markers(files: DataFrame, prefix: str = "audit") -> DataFrame:
    """Inline allow markers, one row per line and allowed id ("" allows all rules)."""
    marks = markers_of(spans_of(marker_pieces(readable(F.col("content")), prefix)), prefix)
    rows = files.select("repo", "path", F.explode_outer(marks).alias("m"))
    return rows.where(F.col("m").isNotNull()).select(
        "repo", "path", F.col("m.line").alias("line"), F.explode("m.ids").alias("rule_part")
    )


def drop_allowed(matches: DataFrame, markers: DataFrame) -> DataFrame:
    """Anti join of matches with allow markers on file and start line; the id test is the residual."""
    m, k = matches.alias("m"), markers.alias("k")
    same_line = (
        (F.col("m.repo") == F.col("k.repo"))
        & (F.col("m.path") == F.col("k.path"))
        & (F.col("m.start_line") == F.col("k.line"))
    )
    return m.join(k, same_line & F.contains(F.col("m.rule_id"), F.col("k.rule_part")), "left_anti")
