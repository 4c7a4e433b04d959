"""Chat formatting with a grammar round trip, in DataFrame operations only.

Grammar of the output (one string per conversation)::

    conversation := turn*
    turn         := "###" " " role ": " body "</turn>" "\\n"

``###`` starts a turn wherever it stands and ``</turn>`` ends one; neither
may occur in a role or body. The parser is deterministic and literal: split
at ``###``; the role is what stands before the first ``": "``; the body ends at
the first ``</turn>``; then backslash escapes are undone.

Each turn is first rendered as it is and parsed again. Where the parse does
not give back exactly that role and text, or the text holds a control
string, the turn is rendered with escapes and parsed once more; the whole
conversation is parsed last, and a difference raises an error.

Escapes: ``\\`` -> ``\\\\``; a ``#`` that two more follow -> ``#\\-``;
``</turn>`` -> ``<\\-/turn>``; in a role also ``": "`` -> ``":\\- "``. They only
insert backslash pairs, so they cannot make a control string, and reading
the pairs from left to right undoes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import text_of

START, END = "###", "</turn>"
#: Roles with a name of their own in the template; any other is written as "=" and the escaped role.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=##)", r"#\\-")
    return F.replace(text, F.lit(END), F.lit("<\\-/turn>"))


def unescaped(text: Column) -> Column:
    """Undoes escaped(); a text without backslashes is returned as it is."""
    undone = F.regexp_replace(text, r"\\(?:-|(\\))", "$1")
    return F.when(F.contains(text, F.lit("\\")), undone).otherwise(text)


def _role_out(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    other = F.concat(F.lit("="), F.replace(escaped(role), F.lit(": "), F.lit(":\\- ")))
    return F.coalesce(F.element_at(named, role), other)


def _role_in(name: Column) -> Column:
    named = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (v, k)])
    return F.coalesce(F.element_at(named, name), unescaped(F.substring(name, 2, 1 << 30)))


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START + " "), _role_out(role), F.lit(": "), body, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, START, -1)

    def turn(piece: Column) -> Column:
        name = F.substring(F.substring_index(piece, ": ", 1), 2, 1 << 30)
        body = F.substring_index(F.substring(piece, F.char_length(name) + 4, F.lit(1 << 30)), END, 1)
        return F.struct(_role_in(name).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _parses_to(rendered: Column, role: Column, text: Column) -> Column:
    return parse(rendered) == F.array(F.struct(role.alias("role"), text.alias("text")))


def chat_format(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(conv, formatted, loss_spans), one row per conversation.

    ``loss_spans`` has (start, length) in code points of ``formatted``, 0-based,
    of the body of every turn by ``loss_role``, in order.

    Defined cases: null text and null role are empty strings; turns are
    ordered by turn (null first), then role, then text; repeated rows are
    turns of their own; a null conversation id is one conversation; texts of
    any length and any content come back exactly; an empty table gives no
    rows; other columns are ignored. A conversation is one string, so the
    rows of one conversation meet in one task; rows are dealt by
    conversation once.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        text_of(role_col).alias("role"),
        text_of(text_col).alias("text"),
    )
    raw = _render(F.col("role"), F.col("text"))
    plain = _parses_to(raw, F.col("role"), F.col("text")) & ~F.contains("text", F.lit(END)) & ~F.contains("text", F.lit(START))
    body = F.when(plain, F.col("text")).otherwise(escaped(F.col("text")))
    rows = rows.withColumn("body", body).withColumn("rendered", _render(F.col("role"), F.col("body")))

    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(F.char_length("rendered")).over(before), F.lit(0))
    )
    span = F.struct(
        (F.col("start") + F.char_length("rendered") - F.char_length("body") - len(END) - 1).cast("long").alias("start"),
        F.char_length("body").cast("long").alias("length"),
    )
    whole = rows.groupBy("conv").agg(
        F.array_sort(
            F.collect_list(
                F.struct("n", "rendered", "role", "text", F.when(F.col("role") == loss_role, span).alias("span"))
            )
        ).alias("t")
    )
    out = whole.select(
        "conv",
        F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["span"].isNotNull()), lambda x: x["span"]).alias("loss_spans"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    same = parse(F.col("formatted")) == F.col("source")
    checked = F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not round-trip: "), F.coalesce(F.col("conv").cast("string"), F.lit("null"))))
    )
    return out.select(F.col("conv").alias(conv_col), checked.alias("formatted"), "loss_spans")
