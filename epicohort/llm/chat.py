"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
the context, and only its reply is trainable. Turns behind the last assistant
turn are no reply's context; they make one more example without a target, so
that the output holds every turn.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts a backslash is doubled, then ``<|`` becomes ``<\\|`` and a line break in a
role ``<\\n``: behind ``<`` a run of backslashes of a text has an even length,
so a single backslash there can only come from the escape, and ``unescape``
gives every text back. No control string can arise inside a turn.

Defined results: a null text or role counts as empty; turns are ordered by
(turn, role, text), null turns first, so ties and repeated rows keep one order
and none is dropped; a null conv_id is a conversation like any other; other
columns are ignored. One conversation is the unit of an example, so its turns
meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TRAINABLE = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("<\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def unescape_text(text: Column) -> Column:
    """As ``unescape``; ``<\\n`` is an escape in roles only and cannot occur in an escaped text."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each example: conv_id, example (from 0), formatted text, and
    the loss mask as code point offsets [loss_start, loss_end) into it; both are
    null in the example without a target."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text")))).alias("_turns"))
    marked = turns.select(
        "conv_id",
        F.transform("_turns", lambda t: F.struct(
            (t["role"] == TRAINABLE).alias("target"),
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            F.lit(END + "\n").alias("tail"))).alias("_turns"))
    last = F.size("_turns") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | F.get(F.col("_turns"), i)["target"])
    whole = lambda t: F.concat(t["head"], t["body"], t["tail"])
    exploded = marked.select("conv_id", "_turns", F.posexplode(ends).alias("example", "_end"))
    final = F.get(F.col("_turns"), F.col("_end"))
    context = F.array_join(F.transform(F.slice("_turns", F.lit(1), F.col("_end")), whole), "")
    parts = exploded.select("conv_id", "example", context.alias("_context"), final.alias("_final"))
    start = F.char_length("_context") + F.char_length(F.col("_final.head"))
    return parts.select(
        "conv_id", "example", F.concat("_context", whole(F.col("_final"))).alias("formatted"),
        F.when(F.col("_final.target"), start).alias("loss_start"),
        F.when(F.col("_final.target"), start + F.char_length(F.col("_final.body"))).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        inner = F.left(piece, F.char_length(piece) - F.lit(len(END) + 1))
        cut = F.instr(inner, F.lit("\n"))
        return F.struct(unescape(F.left(inner, cut - 1)).alias("role"),
                        unescape_text(F.substr(inner, cut + 1)).alias("text"))
    return F.transform(pieces, turn)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What a reader of the examples gets back for each conversation: its turns
    from its longest example, its trainable texts from the loss masks."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape_text(
        F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    read = examples.select("conv_id", "example", "formatted", F.char_length("formatted").cast("long").alias("_chars"),
                           loss.alias("_loss"))
    by_conv = read.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted"))["formatted"].alias("_all"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "_loss"))),
                                 lambda x: F.coalesce(x["_loss"], F.lit(""))), "").alias("_loss"),
        F.sum("_chars").alias("formatted_chars"))
    turns = by_conv.withColumn("_turns", read_turns(F.col("_all")))
    as_text = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(as_text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
