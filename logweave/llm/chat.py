"""Chat formatting with Spark expressions only.

Turns of a conversation are collected, sorted, merged into blocks of adjacent
same-role turns, and concatenated.  The template is

    <|im_start|>ROLE \\n TEXT <|im_sep|> TEXT ... <|im_end|> \\n

(no blanks).  ``<|`` begins every control string, so texts and roles are escaped:
a backslash is doubled, then ``<|`` becomes ``<\\|``; in roles a newline becomes
``<\\-``.  No control string can then occur inside them, and both steps reverse.

The result is a row per conversation: ``segments``, an array of (text, loss)
whose texts concatenate to ``formatted``; ``loss`` marks the assistant's texts.

Defined results: null text or role is empty; rows with equal turn numbers go by
role, then text; null turn numbers come first; rows of a null conv_id are one
conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\-"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\-"), F.lit("\n")))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, n_blocks."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    at = F.sequence(F.lit(0), F.size("t") - 1)
    # where blocks of equal adjacent roles begin, and then the blocks as slices
    opens = F.filter(at, lambda i: (i == 0) | (F.element_at("t", i + 1)["role"] != F.element_at("t", F.greatest(i, F.lit(1)))["role"]))
    df = df.withColumn("b", opens)
    block = lambda i, k: F.struct(
        F.element_at("t", i + 1)["role"].alias("role"),
        F.transform(F.slice("t", i + 1, F.coalesce(F.get("b", k + 1), F.size("t")) - i), lambda x: x["text"]).alias("texts"),
    )
    df = df.withColumn("blocks", F.transform("b", block))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def of(b: Column) -> Column:
        is_loss = b["role"] == F.lit(loss_role)
        inner = F.flatten(F.transform(b["texts"], lambda x, i: F.array(seg(F.when(i == 0, F.lit("")).otherwise(F.lit(SEP)), no), seg(escape(x), is_loss))))
        return F.concat(F.array(seg(F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n")), no)), inner, F.array(seg(F.lit(END), no)))

    df = df.withColumn("segments", F.flatten(F.transform("blocks", of)))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return df.select("conv_id", F.size("blocks").alias("n_blocks"), "segments", formatted.alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation."""
    blocks = F.split(formatted, r"\Q" + END + r"\E", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def of(b: Column) -> Column:
        cut = F.instr(b, "\n")
        role = F.substring(b, F.lit(len(START) + 1), cut - len(START) - 1)
        texts = F.split(F.substring(b, cut + 1, F.char_length(b)), r"\Q" + SEP + r"\E", -1)
        return F.transform(texts, lambda x: F.struct(unescape_role(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, of))


def loss_text(segments: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
