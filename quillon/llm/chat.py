"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its text is under the loss mask. The examples of one
conversation are prefixes of one text, so a conversation is stored once, turn by
turn, and an example names the prefix it reads (``context_chars``) and the span
it trains on; ``with_text`` writes the prefixes out where a trainer wants them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings and what stands for them in a text; a backslash begins nothing else, so the order of undoing is the reverse.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"))
_ROLE = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, pairs: tuple = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, pairs: tuple = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def segments(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """The formatted turns: conv_id, pos, segment, start, example, loss_start, loss_end.

    The segments of a conversation, in the order of ``pos`` (from 1), are its
    formatted text. ``start`` counts the code points before a segment. Turns of
    role ``trained`` have a number among these (``example``) and the span of
    their own text, others null. Turns go by ``turn`` (null first), then role and
    text, so ties and repeated rows have a place each; a null role or text counts
    as empty; a null conv_id is a conversation like any other. An empty table
    gives no rows; other columns are ignored. One shuffle, and a conversation's
    rows stream through one task; texts may be as long as a value may be.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"))
    head = F.concat(F.lit(OPEN), escaped(F.col("_role"), _ROLE), F.lit(COLON))
    made = rows.withColumns({"_head": head, "_body": escaped(F.col("_text")), "_trained": F.col("_role") == trained})
    made = made.withColumn("segment", F.concat("_head", "_body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumns({"pos": F.row_number().over(order), "start": F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0)), "_nth": F.count_if("_trained").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    first = F.col("start") + F.length("_head")
    only = lambda c: F.when(F.col("_trained"), c)
    return placed.select("conv_id", "pos", "segment", "start", only(F.col("_nth")).alias("example"), only(first).alias("loss_start"), only(first + F.length("_body")).alias("loss_end"))


def _target() -> Column:
    """What the loss mask covers in a segment, unescaped."""
    return unescaped(F.col("segment").substr((F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))


def examples(formatted: DataFrame) -> DataFrame:
    """An example per trained turn: conv_id, example, context_turns, context_chars, loss_start, loss_end, target.

    Its text is the first ``loss_end`` code points of the conversation's; the
    first ``context_chars`` are the turns before it; ``target`` is what the loss
    mask covers, unescaped.
    """
    return formatted.where("example is not null").select("conv_id", "example", (F.col("pos") - 1).alias("context_turns"), F.col("start").alias("context_chars"), "loss_start", "loss_end", _target().alias("target"))


def _whole(formatted: DataFrame) -> DataFrame:
    """A row per conversation: its turns in order and its formatted text."""
    part = F.struct("pos", "segment", "example", "loss_start", "loss_end")
    whole = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("_turns"))
    return whole.select("conv_id", F.filter("_turns", lambda t: t["example"].isNotNull()).alias("_examples"), F.array_join(F.col("_turns.segment"), "").alias("_all"))


def _expanded(whole: DataFrame, *keep: str) -> DataFrame:
    """Prefix-target expansion: a row per example with its own text; a conversation without examples has one of nulls. The rows stream, one prefix at a time."""
    each = whole.select(*keep, "_all", F.explode_outer("_examples").alias("_t"))
    return each.select(*keep, F.col("_t.example").alias("example"), F.col("_t.loss_start").alias("loss_start"), F.col("_t.loss_end").alias("loss_end"), F.col("_all").substr(F.lit(1), F.col("_t.loss_end").cast("int")).alias("text"))


def with_text(formatted: DataFrame) -> DataFrame:
    """Examples with their prefix written out (``text``, up to the mask's end): as many characters as all prefixes have, so long conversations grow by the square of their turns."""
    return _expanded(_whole(formatted), "conv_id").where("example is not null")


def parsed(text: Column) -> Column:
    """Turns (role, text) of a conversation's formatted text."""
    pieces = F.split(text, CLOSE, -1)  # what follows the last mark is empty
    body = F.filter(pieces, lambda p, i: i < F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(OPEN) + 1, F.length(piece))
        at = F.locate(COLON, inner)
        role, said = inner.substr(F.lit(1), at - 1), inner.substr(at + len(COLON), F.length(inner))
        return F.struct(unescaped(role, _ROLE).alias("role"), unescaped(said).alias("text"))

    return F.transform(body, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, a row per conversation.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each
    turn), loss_chars and loss_sha256 (what the mask covers in the text of each
    expanded example, unescaped, in their order), formatted_chars. A
    conversation is one value here, as a digest over all of it is its definition.
    """
    turns = _whole(formatted).withColumn("_read", parsed(F.col("_all")))
    said = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    keys = ["conv_id", "n_turns", "turns_sha256", "formatted_chars"]
    read = turns.select("conv_id", "_examples", "_all", F.size("_read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_all").cast("long").alias("formatted_chars"))
    covered = F.col("text").substr((F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    each = _expanded(read, *keys).withColumn("target", unescaped(covered))
    targets = F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "target"))))
    loss = each.groupBy(*keys).agg(F.array_join(targets["target"], "").alias("_loss"))
    return loss.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
