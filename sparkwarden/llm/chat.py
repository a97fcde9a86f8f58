"""Chat formatting with column expressions only: a declarative template, a state machine over roles, loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``open`` + role + ``named`` + text + ``close``; the text has loss if its role is in ``loss``.

    ``controls`` are the strings that must not appear inside a role or text; each begins with a character of ``leads``.
    ``moves`` are the transitions (state, role, next state) of the machine that checks the order of turns: it begins in
    ``start``, has no way back from "invalid", and accepts a conversation that ends in ``accept``.
    """

    open: str = "<|im_start|>"
    named: str = "\n"
    close: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    leads: dict[str, str] = field(default_factory=lambda: {"<": "l", "[": "o", "\n": "n"})
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )


CHAT = Template()


def escaped(text: Column, template: Template, name: bool = False) -> Column:
    """Text without control strings; a backslash opens every escape, so that ``unescaped`` is exact.

    A backslash becomes ``\\s``; the first character of a control string becomes a backslash and its letter in
    ``leads``. In a role (``name``) the string that ends roles is escaped too.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for c in sorted((*template.controls, *([template.named] if name else [])), key=len, reverse=True):
        out = F.replace(out, F.lit(c), F.lit("\\" + template.leads[c[0]] + c[1:]))
    return out


def unescaped(text: Column, template: Template) -> Column:
    for lead, letter in template.leads.items():
        text = F.replace(text, F.lit("\\" + letter), F.lit(lead))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def _order(roles: Column, template: Template) -> Column:
    moves = F.create_map(*[F.lit(x) for state, role, after in template.moves for x in (f"{state} {role}", after)])
    step = lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(" "), role)), F.lit("invalid"))
    return F.aggregate(roles, F.lit(template.start), step)


def formatted(rows: DataFrame, template: Template = CHAT, key: str = "conv_id") -> DataFrame:
    """One row per conversation: (key, valid, segments array<struct<text, loss>>, formatted).

    Rows (key, turn, role, text) go by turn; equal turns by role, then text, and repeated rows are repeated turns. Null
    roles and texts are empty. ``valid`` tells whether the turns keep the template's order; conversations that don't are
    formatted all the same, any role by its name. A null key is a conversation of its own; no rows give no rows. The
    unit of the result is a conversation, so one conversation must fit into a row.
    """
    text, role = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in ("text", "role"))
    turn = F.struct(
        rows["turn"].alias("turn"), role.alias("role"), text.alias("text")
    )
    turns = rows.groupBy(rows[key].alias(key)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(
                    F.concat(F.lit(template.open), escaped(t["role"], template, name=True), F.lit(template.named)).alias("text"),
                    F.lit(False).alias("loss"),
                ),
                F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(*template.loss).alias("loss")),
                F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return turns.select(
        key,
        _order(F.transform("turns", lambda t: t["role"]), template).isin(*template.accept).alias("valid"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parsed(out: DataFrame, template: Template = CHAT) -> DataFrame:
    """``formatted`` rows with ``turns`` array<struct<role, text>> read back from the formatted text alone."""
    parts = F.split("formatted", "\\Q" + template.open + "\\E")
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    named, close = len(template.named), len(template.close)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, template.named, 1)
        begin = F.char_length(role) + 1 + named
        text = F.substring(part, begin, F.char_length(part) - (begin - 1) - close)
        return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))

    return out.withColumn("turns", F.transform(body, turn))


def digests(out: DataFrame, template: Template = CHAT, key: str = "conv_id") -> DataFrame:
    """Counts and digests of what ``parsed`` and the loss flags give back."""
    back = parsed(out, template)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), ""
    )
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
