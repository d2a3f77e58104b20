"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is written ``<turn>role`` newline text ``</turn>`` newline. Inside
texts and roles every string ``<``, any backslashes, ``turn>`` or ``/turn>``
gets one backslash more after the ``<``; reading takes one away. In roles,
backslashes and line ends are escaped first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn>)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn>)", r"<$1$2")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    """Backslash pairs are split out first, so that an escaped backslash before an n stays one."""
    return F.array_join(F.transform(F.split(unescaped(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def expand(turns: DataFrame) -> DataFrame:
    """One example per assistant turn of turns(conv_id, turn, role, text).

    Gives conv_id, example (from 0), context, target, closing: context holds
    all turns before and the opening of the reply, target is the reply, the
    only trainable part, closing ends the turn. Turns after the last
    assistant turn (or all, if there is none) come as one last example whose
    context is the whole conversation and whose target is null, so that no
    turn is lost. Null roles and texts are empty; turns that share a number
    are ordered by role and text; a null conv_id is a conversation.
    """
    clean = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    conv = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    conv = conv.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == "assistant").alias("own"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escaped(t["text"])).alias("texts"),
    )
    conv = conv.withColumn("ends", F.filter(F.transform("own", lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
    n = F.size("own")
    rest = F.when(F.element_at("own", -1), F.array().cast("array<int>")).otherwise(F.array(n))
    each = conv.select("conv_id", "heads", "texts", F.posexplode(F.concat("ends", rest)).alias("example", "i"))
    whole = F.zip_with("heads", "texts", lambda h, t: F.concat(h, t, F.lit(CLOSE + "\n")))
    before = F.array_join(F.slice(whole, F.lit(1), F.col("i")), "")
    last = F.get("heads", F.col("i"))
    return each.select(
        "conv_id", F.col("example").cast("long").alias("example"),
        F.concat(before, F.coalesce(last, F.lit(""))).alias("context"), F.get("texts", F.col("i")).alias("target"),
        F.when(last.isNotNull(), CLOSE + "\n").otherwise("").alias("closing"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """The formatted text of each example of turns, and its loss mask as a span of code points.

    Gives conv_id, example, text, loss_start (from 0), loss_length; an example
    without a target has the empty span at its end.
    """
    own = expand(turns)
    target = F.coalesce("target", F.lit(""))
    return own.select(
        "conv_id", "example", F.concat("context", target, "closing").alias("text"),
        F.length("context").cast("long").alias("loss_start"), F.length(target).cast("long").alias("loss_length"),
    )


def parse(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    blocks = F.filter(F.split(text, OPEN), lambda b: b != "")
    body = lambda b: F.substring_index(b, CLOSE + "\n", 1)
    return F.transform(blocks, lambda b: F.struct(
        unescaped_role(F.substring_index(body(b), "\n", 1)).alias("role"),
        unescaped(F.substr(body(b), F.length(F.substring_index(body(b), "\n", 1)) + F.lit(2))).alias("text"),
    ))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the examples as they are written: turns, text under the loss mask, and length.

    The turns are parsed from the longest (last) example; the text under the
    mask is cut from each example's text by its span. formatted_chars is the
    length of all examples.
    """
    masked = F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int"))
    per = formatted.select("conv_id", "example", "text", unescaped(masked).alias("loss"))
    per = per.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    per = per.withColumn("turns", parse(F.col("last")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
