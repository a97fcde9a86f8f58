"""Functions that no code in use mentions.

A file becomes, in its own row, a list of functions with the names each mentions; text goes through no shuffle. Names in use
then spread from the roots (public functions, entry points, code outside functions) over an inverted index of mentions, so that
functions used only by unused ones are found too, in chains and in cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.functions.arrays import let
from sparkwarden.functions.code import FAMILIES, code_only, family_of
from sparkwarden.functions.text import regex_spans
from sparkwarden.session import stored

VERIFIER = "deadcode"
DESCRIPTION = "Private functions that nothing in use mentions"
RULE, SEVERITY = "deadcode.unused-function", "low"

#: How a function begins after its indentation, up to its name.
HEADS = {
    "python": r"(?:async[ \t]+)?def[ \t]+",
    "rust": r"""(?:pub(?:\([^()\n]*+\))?[ \t]+)?(?:(?:const|async|unsafe|default|extern(?:[ \t]+"[^"\n]*")?)[ \t]+)*+fn[ \t]+""",
    "script": r"(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function(?:[ \t]*\*[ \t]*|[ \t]+)",
    "go": r"func[ \t]+(?:\([^()\n]*+\)[ \t]*)?",
}
_NAME = r"[A-Za-z_$][\w$]*+"
#: Functions of these forms can be used from elsewhere.
PUBLIC = {
    "python": r"def[ \t]+(?:[^\W_]|__\w*__$)",
    "rust": r"^[ \t]*pub[ \t]|fn[ \t]+main$",
    "script": r"^[ \t]*export\b",
    "go": r"[ \t)](?:[A-Z][\w$]*|main|init)$",
}
#: Lines above a function that may hand it to someone else: decorators, and attributes but those that only advise the compiler.
_ABOVE = {
    "python": r"@[^\n]*+",
    "script": r"@[^\n]*+",
    "rust": r"#\[(?!(?:inline|must_use|allow|warn|deny|expect|cold|doc|cfg|deprecated|track_caller)\b)[^\n]*+",
}
_RUN_ABOVE = r"(?:[ \t]*+(?:@|#\[)[^\n]*+\n)++"
#: Blocks whose functions are called through a trait.
_TRAIT_BLOCK = r"(?:impl\b[^\n{]*\bfor\b|(?:pub(?:\([^()\n]*+\))?[ \t]+)?(?:unsafe[ \t]+)?trait\b)"
#: What belongs to a block that begins at an indentation: deeper lines, blank lines, and lines that begin by closing or opening one.
_REST = r"(?:\n(?:[ \t]*+(?=\n|\z)|\{0}[ \t]++[^\n]*+|\{0}[)\]}}{{][^\n]*+))*+"

_NONE = "cast(array() as array<string>)"


def _names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)))


def _functions(code: Column, family: str) -> Column:
    """``struct<functions, outside>``: each function's name, line, whether it is a root and the names it mentions, and the names outside."""
    head = HEADS[family]
    begin = rf"(?m)^[ \t]*+{head}{_NAME}"
    body = rf"([ \t]*+){head}{_NAME}[^\n]*+" + _REST.format("2")
    bodies = F.regexp_extract_all(code, F.lit(f"(?m)^(?=({body}))"), F.lit(1))
    outside = F.regexp_replace(code, F.lit(f"(?m)^{body.replace(_REST.format('2'), _REST.format('1'))}"), F.lit(""))
    handed = F.expr(_NONE)
    if family in _ABOVE:
        runs = F.regexp_extract_all(code, F.lit(rf"(?m)^{_RUN_ABOVE}(?:[ \t]*+{head}{_NAME})?"), F.lit(0))
        runs = F.filter(runs, lambda run: F.rlike(run, F.lit(rf"(?m)^[ \t]*+{_ABOVE[family]}")))
        handed = F.transform(runs, lambda run: F.regexp_extract(run, rf"\n[ \t]*+{head}({_NAME})$", 1))
    if family == "rust":
        block = rf"(?m)^([ \t]*+){_TRAIT_BLOCK}[^\n]*+" + _REST.format("1")
        blocks = F.regexp_extract_all(code, F.lit(block), F.lit(0))
        handed = F.concat(handed, F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(rf"\bfn[ \t]+({_NAME})"), F.lit(1)))))
    own_head = rf"\b(?:def|fn|function(?:[ \t]*\*)?|func(?:[ \t]+\([^()\n]*+\))?)[ \t]+{_NAME}"

    def build(spans: Column, rooted: Column) -> Column:
        def one(span: Column, text: Column) -> Column:
            name = F.regexp_extract(span["text"], rf"({_NAME})$", 1)
            return F.struct(
                name.alias("name"), span["start_line"].alias("start_line"),
                (F.rlike(span["text"], F.lit(PUBLIC[family])) | F.array_contains(rooted, name)).alias("root"),
                _names(F.regexp_replace(text, F.lit(own_head), F.lit(" "))).alias("mentions"),
            )

        return F.zip_with(spans, bodies, one)

    return F.struct(
        let(regex_spans(code, begin), lambda spans: let(handed, lambda rooted: build(spans, rooted))).alias("functions"),
        _names(F.regexp_replace(outside, F.lit(own_head), F.lit(" "))).alias("outside"),
    )


def _uses(text: Column, family: str) -> Column:
    return let(code_only(text, family), lambda code: _functions(code, family))


def function_uses(files: DataFrame) -> DataFrame:
    """``repo, path, family, functions array<struct<name, start_line, root, mentions>>, outside array<string>`` of code files; no shuffle.

    A function reaches from its first line over all deeper, blank and closing lines below it. Null texts have no functions.
    """
    out = None
    for family in dict.fromkeys(FAMILIES.values()):
        out = (F if out is None else out).when(F.col("family") == family, _uses(F.col("content"), family))
    rows = files.withColumn("family", family_of(F.col("language"))).where("family IS NOT NULL AND content IS NOT NULL")
    return rows.select("repo", "path", "family", out.alias("uses")).select("repo", "path", "family", "uses.*")


def dead_functions(files: DataFrame) -> DataFrame:
    """``repo, path, name, start_line, verifier_id, rule_id, severity`` of private functions that nothing in use mentions.

    A name counts as used by every code of its repository and language family in use that mentions it outside comments, in
    strings too; all functions of that name are then in use. Public functions, entry points, functions under decorators or attributes, and those
    of Rust traits and their implementations are in use, as is all code outside functions.

    Each round adds the names that newly used functions mention, by equi joins on (repo, family, name) on rows without text;
    there are as many rounds as the longest shortest chain of calls from a root to a private function.
    """
    uses = stored(function_uses(files))
    key = ["repo", "family", "name"]
    functions = uses.select("repo", "path", "family", F.explode("functions").alias("f")).select("repo", "path", "family", "f.*")
    private = stored(functions.where("NOT root").select("repo", "family", "path", "name", "start_line", "mentions"))
    defined = private.select(*key).distinct()
    # Mentions of the names of private functions only; the inverted index of the roots, and the calls among private functions.
    rooted = functions.where("root").select("repo", "family", F.explode("mentions").alias("name"))
    rooted = rooted.unionByName(uses.select("repo", "family", F.explode("outside").alias("name"))).distinct()
    frontier = stored(rooted.join(defined, key, "left_semi"))
    calls = private.select("repo", "family", F.col("name").alias("caller"), F.explode("mentions").alias("name")).where("caller <> name").distinct()
    calls = stored(calls.join(defined, key, "left_semi"))
    used = frontier
    while not frontier.isEmpty():
        reached = calls.join(frontier.withColumnRenamed("name", "caller"), ["repo", "family", "caller"], "left_semi")
        frontier = stored(reached.select(*key).distinct().join(used, key, "left_anti"))
        used = used.unionByName(frontier)
    dead = private.join(used, key, "left_anti")
    return dead.select(
        "repo", "path", "name", "start_line", F.lit(VERIFIER).alias("verifier_id"), F.lit(RULE).alias("rule_id"), F.lit(SEVERITY).alias("severity")
    )
