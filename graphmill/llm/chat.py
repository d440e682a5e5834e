"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context, only its reply is trainable. Turns after the last reply form one more
example without a target, so that the output holds every turn.

A turn is written `<s>[role]text</s>`. Role and text are escaped: `&`, `<`, `>`,
`[` and `]` become character references, so no control string of this or another
template (`</s>`, `[INST]`, `<|im_end|>`) survives inside a text, and unescaping
gives back each text as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: `&` first when escaping, last when unescaping.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"))
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, formatted, loss_start, loss_length: an example per assistant turn.

    turns: conv_id, turn, role, text, one row a turn, ordered by turn, then role
    and text where turns tie (a null turn first). A null role or text is empty;
    a null conv_id is a conversation of its own. Repeated rows are repeated turns.
    loss_start counts characters from 0; loss_length is 0 in an example without a
    target, null start there. Other columns are ignored.
    """
    one = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == TARGET_ROLE).alias("target"),
        F.transform("turns", lambda t: F.concat(F.lit("<s>["), escape(t["role"]), F.lit("]"))).alias("head"),
        F.transform("turns", lambda t: escape(t["text"])).alias("body"),
        F.size("turns").alias("n"),
    )
    last = F.sequence(F.lit(1), F.col("n"))
    ends = written.withColumn("ends", F.filter(last, lambda i: F.element_at("target", i) | (i == F.col("n"))))
    each = ends.select("conv_id", "target", "head", "body", F.posexplode("ends").alias("example", "n_turns"))
    pieces = F.zip_with(F.slice("head", 1, F.col("n_turns")), F.slice("body", 1, F.col("n_turns")), lambda h, b: F.concat(h, b, F.lit("</s>")))
    is_target = F.element_at("target", F.col("n_turns"))
    formatted = each.select(
        "conv_id",
        "example",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.concat_ws("", pieces).alias("formatted"),
        F.when(is_target, F.char_length(F.element_at("body", F.col("n_turns")))).otherwise(0).cast("long").alias("loss_length"),
        is_target.alias("has_target"),
    )
    start = F.char_length("formatted") - F.char_length(F.lit("</s>")) - F.col("loss_length")
    return formatted.select("conv_id", "example", "n_turns", "formatted", F.when(F.col("has_target"), start.cast("long")).alias("loss_start"), "loss_length")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    parts = F.filter(F.split(formatted, "</s>"), lambda p: p != "")
    head = F.char_length(F.lit("<s>[")) + 1
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(head)), "]", 1)).alias("role"),
            unescape(F.substr(p, F.locate("]", p) + 1)).alias("text"),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from examples().

    One row for each conversation, null conv_ids are one; an example that is repeated counts
    again. No examples give no rows.
    """
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substr("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int"))))
    whole = formatted.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(F.col("example"), F.coalesce(loss, F.lit("")).alias("loss")))), lambda x: x["loss"])).alias("loss"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    turns = whole.withColumn("turns", read_back(F.col("longest")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
