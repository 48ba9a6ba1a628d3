"""Chat formatting: turns as one marked text per conversation, checked by reading it back.

Grammar of the output, in which a text cannot be mistaken for a mark::

    conversation -> turn*
    turn         -> START role NEWLINE text END NEWLINE
    role, text   -> strings without START and END; a role has no NEWLINE either

A mark inside a role or text is escaped by a backslash after its ``<``; marks that already have
backslashes there get one more, so the escape can be undone. A line break in a role becomes the
mark ``<|nl|>``. Each turn is rendered as it is, parsed again, and compared with its source; if it
does not come back, what conflicts is escaped, first the text, then the role, then both, until the turn is
identical. Then the whole conversation is parsed and compared. All of it is SQL functions.

A formatted conversation is one training example, so its turns meet in one row, of at most 2 GB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
LEARNT = "assistant"
_MARK = r"\|(?:im_start|im_end|nl)\|>"


def escape(text: Column) -> Column:
    """One more backslash in every mark."""
    return F.regexp_replace(text, rf"<(\\*{_MARK})", r"<\\$1")


def unescape(text: Column) -> Column:
    """One backslash less in every mark that has any."""
    return F.regexp_replace(text, rf"<\\(\\*{_MARK})", "<$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Turns (role, text, as it stands in the output) of a formatted text; NULL where the grammar does not hold."""
    parts = F.split(formatted, f"\\Q{END}\\E\n", -1)
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        role, raw = F.substr(head, F.lit(len(START) + 1)), F.substr(part, F.length(head) + 2)
        marked = part.startswith(START) & part.contains("\n")
        clean = ~F.substr(part, F.lit(2)).contains(START) & ~part.contains(END)
        return F.when(marked & clean, F.struct(unescape_role(role).alias("role"), unescape(raw).alias("text"), raw.alias("raw")))

    turns = F.transform(bodies, turn)
    return F.when((F.element_at(parts, -1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def render_checked(role: Column, text: Column) -> Column:
    """The first rendering that is read back as this turn: as it is, or with its text, its role, or both escaped."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))

    def identical(rendered: Column) -> Column:
        return F.coalesce(plain_turns(parse(rendered)) == source, F.lit(False))

    tries = [render(r, t) for r in (role, escape_role(role)) for t in (text, escape(text))]
    return reduce(lambda rest, x: F.when(identical(x), x).otherwise(rest), tries[2::-1], tries[3])


def plain_turns(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learnt: str = LEARNT) -> DataFrame:
    """(id, formatted, loss_spans, turns, identical) of every conversation.

    ``loss_spans`` holds start and length, in code points of ``formatted``, of the texts whose role is
    ``learnt``. ``turns`` is what the parser reads back from ``formatted``; ``identical`` says that these are
    the turns of the source, and holds for any content.

    Rows are ordered by turn, missing ones first, then by role and text; rows that are repeated stay repeated.
    A missing role or text is empty. Rows without an id are one conversation, without an id.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    whole = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{turn}`").alias("_turn"), whole(role).alias("_role"), whole(text).alias("_text"))
    rendered = rows.withColumn("_piece", render_checked(F.col("_role"), F.col("_text")))
    # Rows of a conversation move once: the running length and the aggregate use the same exchange.
    before = Window.partitionBy("_id").orderBy("_turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumn("_begin", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)))
    body = F.substr("_piece", F.length(F.substring_index("_piece", "\n", 1)) + 2)
    head = F.length("_piece") - F.length(body)
    span = F.struct((F.col("_begin") + head).alias("start"), (F.length(body) - len(END) - 1).cast("long").alias("length"))
    entry = F.struct("_begin", "_turn", F.col("_role").alias("role"), F.col("_text").alias("text"), "_piece",
                     F.when(F.col("_role") == learnt, span).alias("span"))
    grouped = placed.groupBy("_id").agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    joined = grouped.select(
        F.col("_id").alias(id_col), F.array_join(F.transform("_rows", lambda r: r["_piece"]), "").alias("formatted"),
        F.filter(F.transform("_rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        plain_turns(F.col("_rows")).alias("_source"))
    read = joined.withColumn("turns", parse(F.col("formatted")))
    return read.select(id_col, "formatted", "loss_spans", "turns",
                       F.coalesce(plain_turns(F.col("turns")) == F.col("_source"), F.lit(False)).alias("identical"))


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id", learnt: str = LEARNT) -> DataFrame:
    """Counts and digests of what is read back; a conversation that is not identical to its source raises an error."""
    turns = F.when(F.col("identical"), F.col("turns")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not give its turns back")).cast("array<struct<role:string,text:string,raw:string>>"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under_mask = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == learnt), lambda t: unescape(t["raw"])), "")
    return formatted.select(
        id_col, F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(under_mask).cast("long").alias("loss_chars"), F.sha2(under_mask.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
