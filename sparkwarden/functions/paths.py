"""Path functions: extension, language, globs and ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# File extensions by language.
LANGUAGE_EXTENSIONS = {
    "rust": ["rs"],
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py", "pyi"],
    "go": ["go"],
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent folder without a trailing slash; empty at the root."""
    return F.regexp_replace(path, F.lit("/?[^/]*$"), F.lit(""))


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty for none and for dotfiles."""
    return F.regexp_extract(path, r"[^/][^/]*\.([^./]*)$", 1)


def language_of(path: Column) -> Column:
    ext = F.lower(extension(path))
    out = None
    for language, exts in LANGUAGE_EXTENSIONS.items():
        out = (F if out is None else out).when(ext.isin(exts), F.lit(language))
    return out.otherwise(F.lit("unknown"))


def class_regex(members: str, negated: bool) -> str:
    """Java regex of a glob's character class; a range that runs backwards holds nothing."""
    parts = re.findall(r"(?s)(.)-(.)|(.)", members)
    code = lambda c: f"\\u{ord(c):04x}" if ord(c) < 0x10000 else c
    inside = [code(one) if one else f"{code(a)}-{code(b)}" for a, b, one in parts if one or a <= b]
    if not inside:
        return "(?s:.)" if negated else "(?!)"
    return "[" + "^" * negated + "".join(inside) + "]"


def glob_to_regex(glob: str) -> str | None:
    """Whole-path regex of a shell glob, or None if the glob is not valid.

    ``*`` and ``?`` also cross ``/``. ``**`` is valid only as a whole path component.
    """
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "?":
            out.append("(?s:.)")
        elif c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            if j - i > 2:
                return None
            if j - i == 2:
                if (i > 0 and glob[i - 1] != "/") or (j < len(glob) and glob[j] != "/"):
                    return None
                if j < len(glob):
                    out.append("(?s:.*/)?")
                    j += 1
                else:
                    out.append("(?s:.*)")
            else:
                out.append("(?s:.*)")
            i = j
            continue
        elif c == "[":
            k = i + 1
            negated = k < len(glob) and glob[k] == "!"
            k += negated
            close = glob.find("]", k + 1)
            if close < 0:
                return None
            out.append(class_regex(glob[k:close], negated))
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


# What an ignore pattern is made of: double stars with their slashes, stars, classes, escapes, single characters.
_IGNORE_TOKEN = r"(?s)(^\*\*/|/\*\*/|/\*\*$|\*+|\[[!^]?\]?[^\]]*\]|\\.|.)"
_IGNORE_STEPS = {"**/": "(?:.*/)?", "/**/": "/(?:.*/)?", "/**": "/.+", "?": "[^/]"}


def _char_regex(char: Column) -> Column:
    """A character by its code, which no regex syntax can touch."""
    return F.concat(F.lit("\\x{"), F.lower(F.hex(F.ascii(char))), F.lit("}"))


def _class_items(token: Column) -> Column:
    """Members of a class token: ranges ``a-b`` and single characters."""
    inner = F.regexp_replace(token, F.lit(r"(?s)^\[[!^]?(.*)\]$"), F.lit("$1"))
    return F.regexp_extract_all(inner, F.lit("(?s)(.-.|.)"), F.lit(1))


def _is_range(item: Column) -> Column:
    return F.length(item) == 3


def _ignore_tokens(pattern: Column) -> tuple[Column, Column]:
    """The pattern without its leading and trailing slashes as tokens, and whether it is anchored."""
    body = F.regexp_replace(pattern, F.lit("/+$"), F.lit(""))
    rel = F.regexp_replace(F.regexp_replace(body, F.lit("^/"), F.lit("")), F.lit(r"(/\*\*)+/"), F.lit("/**/"))
    return F.regexp_extract_all(rel, F.lit(_IGNORE_TOKEN), F.lit(1)), F.contains(body, F.lit("/"))


def ignore_pattern_valid(pattern: Column) -> Column:
    """False for an unclosed class, a range that runs backwards and a backslash at the end: such rules are left out."""
    tokens, _ = _ignore_tokens(pattern)

    def bad(token: Column) -> Column:
        is_class = F.startswith(token, F.lit("[")) & (F.length(token) > 1)
        backwards = F.exists(
            _class_items(token), lambda i: _is_range(i) & (F.ascii(F.substring(i, 1, 1)) > F.ascii(F.substring(i, 3, 1)))
        )
        return (token == "[") | (token == "\\") | (is_class & backwards)

    return ~F.exists(tokens, bad)


def ignore_pattern_regex(pattern: Column) -> Column:
    """Regex of one valid ignore-file pattern, for paths relative to the folder of that ignore file.

    A pattern with a slash before its end is anchored; any other one matches at every depth. Every character without a
    meaning in the pattern stands for itself, also after a backslash.
    """
    tokens, anchored = _ignore_tokens(pattern)
    steps = F.create_map(*[F.lit(x) for pair in _IGNORE_STEPS.items() for x in pair])

    def regex(token: Column) -> Column:
        negated = token.rlike(r"^\[[!^]")
        members = F.transform(
            _class_items(token),
            lambda i: F.when(_is_range(i), F.concat(_char_regex(F.substring(i, 1, 1)), F.lit("-"), _char_regex(F.substring(i, 3, 1)))).otherwise(_char_regex(i)),
        )
        return (
            F.when(F.try_element_at(steps, token).isNotNull(), F.try_element_at(steps, token))
            .when(F.startswith(token, F.lit("*")), F.lit("[^/]*"))
            .when(
                F.startswith(token, F.lit("[")) & (F.length(token) > 1),
                F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), F.array_join(members, ""), F.lit("]")),
            )
            .when(F.startswith(token, F.lit("\\")) & (F.length(token) > 1), _char_regex(F.substring(token, 2, 1)))
            .otherwise(_char_regex(token))
        )

    quoted = F.array_join(F.transform(tokens, regex), "")
    return F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), quoted, F.lit("$"))
