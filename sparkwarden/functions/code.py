"""Comments and strings of code files, as patterns that read any text in linear time, unclosed ones to its end."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkwarden.functions.text import pieces, readable

#: Language -> family of languages that share syntax and modules.
FAMILIES = {"python": "python", "rust": "rust", "javascript": "script", "typescript": "script", "go": "go"}

_LINE_DQ = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
_LINE_SQ = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_SLASHES = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_TRIPLE = r'[A-Za-z]{0,2}(?:"""(?s:.*?)(?:"""|\z)|' + r"'''(?s:.*?)(?:'''|\z))"
_RUST_RAW = r'b?r##"(?s:.*?)(?:"##|\z)|b?r#"(?s:.*?)(?:"#|\z)|b?r"[^"]*+(?:"|\z)'
_RUST_STRING = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\z)'

#: Comments and strings by family, leftmost first.
HIDDEN = {
    "python": rf"#[^\n]*+|{_TRIPLE}|{_LINE_DQ}|{_LINE_SQ}",
    "rust": rf"{_SLASHES}|{_RUST_RAW}|{_RUST_STRING}|'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'",
    "script": rf"{_SLASHES}|{_LINE_DQ}|{_LINE_SQ}|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+(?:`|\z)",
    "go": rf"{_SLASHES}|{_LINE_DQ}|{_LINE_SQ}|`[^`]*+(?:`|\z)",
}


def family_of(language: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])[language]


def unix(text: Column) -> Column:
    return F.replace(readable(text), F.lit("\r\n"), F.lit("\n"))


def without_hidden(text: Column, family: str) -> Column:
    """Text with its comments removed and its strings empty."""
    return F.regexp_replace(unix(text), F.lit(HIDDEN[family]), F.lit('""'))


def code_only(text: Column, family: str) -> Column:
    """Text without comments (and Python's plain triple-quoted strings), line for line; other strings stay, on one line."""
    hidden = r"^(?://|/\*)" if family != "python" else r"""^(?:#|[rRuUbB]{0,2}(?:\"{3}|'{3}))"""

    def shown(piece: Column, i: Column) -> Column:
        breaks = F.regexp_replace(piece, F.lit(r"[^\n]++"), F.lit(""))
        flat = F.concat(F.translate(piece, "\n", " "), breaks)
        return F.when(i % 2 == 0, piece).when(F.rlike(piece, F.lit(hidden)), breaks).otherwise(flat)

    return F.array_join(F.transform(pieces(unix(text), HIDDEN[family]), shown), "")
