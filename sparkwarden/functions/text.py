"""Text functions as column expressions: regex spans with positions, entropy, previews, line handling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkwarden.functions.arrays import let, numbers, running

# Splitting character around matches. It cannot be typed in source text; where a file holds it anyway,
# it is read as DEL, which is also one byte and neither space nor word character.
MARK = "\x01"
MARK_STAND_IN = "\x7f"

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 up to ``lo``, 1 from ``hi``, linear between. With hi < lo the ramp falls."""
    return F.greatest(F.least((x - F.lit(lo)) / F.lit(hi - lo), F.lit(1.0)), F.lit(0.0))


def settled(x: Column) -> Column:
    """Six decimals. The nudge sends a value that is a tie but for floating-point noise upwards, always."""
    return F.round(x + F.lit(1e-9), 6)


def ascii_lower(s: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would also change other letters."""
    return F.translate(s, _ASCII_UPPER, _ASCII_UPPER.lower())


def strip(s: Column) -> Column:
    """Remove white space (any Unicode kind) at both ends; ``trim`` removes plain spaces only."""
    return F.regexp_replace(s, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def count_literal(s: Column, needle: Column) -> Column:
    """Number of non-overlapping occurrences of ``needle``; 0 for an empty needle."""
    width = F.octet_length(needle)
    removed = F.octet_length(s) - F.octet_length(F.replace(s, needle, F.lit("")))
    return F.coalesce(F.try_divide(removed, width).cast("int"), F.lit(0))


def occurs_twice(s: Column, needle: Column) -> Column:
    """True if ``needle`` occurs at least twice without overlap. Stops at the second hit."""
    first = F.instr(s, needle)
    again = F.call_function("locate", needle, s, first + F.length(needle))
    return (F.length(needle) > 0) & (first > 0) & (again > 0)


def lines(s: Column) -> Column:
    """Lines without their ends. CR LF and LF end a line; a final line end opens no further line."""
    parts = F.split(F.replace(s, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def line_count(s: Column) -> Column:
    """Size of ``lines(s)`` without building the array."""
    breaks = F.octet_length(s) - F.octet_length(F.replace(s, F.lit("\n"), F.lit("")))
    return breaks + F.when((s != "") & ~F.endswith(s, F.lit("\n")), 1).otherwise(0)


def matched_bytes(s: Column, pattern: str) -> Column:
    """Total bytes covered by all matches of a literal pattern."""
    return F.octet_length(s) - F.octet_length(F.regexp_replace(s, F.lit(pattern), F.lit("")))


def ascii_ws_ratio(s: Column) -> Column:
    """Share of bytes that are ASCII white space (space, tab, LF, CR, FF)."""
    stripped = F.octet_length(F.translate(s, " \t\n\r\f", ""))
    return F.coalesce(F.try_divide(F.octet_length(s) - stripped, F.octet_length(s)), F.lit(0.0))


def shannon_entropy(s: Column) -> Column:
    """Bits per byte of the UTF-8 form; 0 for an empty string.

    Each byte becomes one character, and each distinct character is counted by removal, so the cost is
    at most 256 native passes over the text.
    """
    per_byte = F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")

    def bits(t: Column) -> Column:
        n = F.length(t)
        distinct = F.filter(F.array_distinct(F.split(t, "")), lambda c: c != "")

        def weight(c: Column) -> Column:
            count = (n - F.length(F.replace(t, c, F.lit("")))).cast("double")
            return count * F.log2(count)

        total = F.aggregate(distinct, F.lit(0.0), lambda acc, c: acc + weight(c))
        return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.log2(n.cast("double")) - total / n, F.lit(0.0)))

    return let(per_byte, bits)


def preview(s: Column) -> Column:
    """The text itself up to 50 bytes, else its first 50 characters and an ellipsis."""
    return F.when(F.octet_length(s) <= 50, s).otherwise(F.concat(F.substring(s, 1, 50), F.lit("…")))


def in_ranges(line: Column, ranges: Column) -> Column:
    """True if ``line`` lies in any half-open range ``[start, end)``."""
    return F.exists(ranges, lambda r: (line >= r["start"]) & (line < r["end"]))


# --- matches with positions -------------------------------------------------------------------------

def readable(s: Column) -> Column:
    """``s`` without the splitting character."""
    return F.when(F.contains(s, F.lit(MARK)), F.translate(s, MARK, MARK_STAND_IN)).otherwise(s)


def pieces(s: Column, pattern: str) -> Column:
    """Text between and inside matches, in turn: odd places are text, even places are matches.

    ``pattern`` is a literal without capture groups that never matches the empty string.
    """
    return F.split(F.regexp_replace(s, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1)


def _measure(p: Column) -> Column:
    breaks = F.octet_length(p) - F.octet_length(F.replace(p, F.lit("\n"), F.lit("")))
    return F.struct(
        F.length(p).alias("offset"),
        breaks.alias("breaks"),
        F.length(F.substring_index(p, "\n", -1)).alias("tail"),
    )


def _advance(a: Column, b: Column) -> Column:
    return F.struct(
        (a["offset"] + b["offset"]).alias("offset"),
        (a["breaks"] + b["breaks"]).alias("breaks"),
        F.when(b["breaks"] > 0, b["tail"]).otherwise(a["tail"] + b["tail"]).alias("tail"),
    )


def positions(parts: Column) -> Column:
    """Where each piece starts (0-based character offset, line breaks before it, characters since the last one)."""
    zero = F.struct(F.lit(0).alias("offset"), F.lit(0).alias("breaks"), F.lit(0).alias("tail"))
    return running(F.transform(parts, _measure), zero, _advance)


def spans_of(parts: Column) -> Column:
    """The matches in ``pieces`` output, with offsets and 1-based line/column of start and end (exclusive)."""

    def span(text: Column, start: Column, end: Column) -> Column:
        return F.struct(
            start["offset"].alias("start"),
            end["offset"].alias("end"),
            (start["breaks"] + 1).alias("start_line"),
            (start["tail"] + 1).alias("start_col"),
            (end["breaks"] + 1).alias("end_line"),
            (end["tail"] + 1).alias("end_col"),
            text.alias("text"),
        )

    def build(ps: Column, at: Column) -> Column:
        places = numbers(F.floor(F.size(ps) / 2))
        return F.transform(places, lambda n: span(F.get(ps, n * 2 - 1), F.get(at, n * 2 - 1), F.get(at, n * 2)))

    return let(parts, lambda ps: let(positions(ps), lambda at: build(ps, at)))


def regex_spans(s: Column, pattern: str) -> Column:
    """All non-overlapping matches as ``array<struct<start,end,start_line,start_col,end_line,end_col,text>>``."""
    return spans_of(pieces(readable(s), pattern))


def line_col(s: Column, offset: Column) -> Column:
    """1-based line and column of a 0-based character offset."""
    before = F.substring(s, F.lit(1), offset)
    return F.struct(
        (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"),
        (F.length(F.substring_index(before, "\n", -1)) + 1).alias("col"),
    )
