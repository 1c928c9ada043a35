"""Conversations as training text: one example per assistant turn, with only that turn's text trainable.

The template marks a turn as `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end. Inside texts and
roles every `<` that stands before bars gets one bar more, so no text can hold a control string, and the step back is
exact: a control string has one bar, an escaped one two or more. A line end in a role becomes `<|nl|>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template and the role that is trained on.
START, END, BREAK, TRAINED = "<|im_start|>", "<|im_end|>", "<|nl|>", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", r"<|$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def examples(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, example, last, text, start, length): every assistant turn with all turns before it.

    text is the formatted example; `length` code points from `start` are under the loss mask. Turns after the last
    assistant turn, or all turns of a conversation without one, make an example with an empty mask, so that the last
    example of a conversation always holds all its turns. Examples are numbered by the turn they end with, from 1.

    Null roles and texts are empty. Turns go by number, then role, then text, nulls first; repeated numbers and rows
    stay as turns of their own. Rows without a key are one conversation. Other columns are not read. An empty table
    gives no example. An example holds all its context, so a conversation of n turns gives text in the order of n * n;
    rows shuffle once, by conversation, and examples are made one at a time after that.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    talks = turns.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"))
    talks = talks.select(
        "_key", F.size("turns").alias("n"), F.transform("turns", lambda t: t["role"] == TRAINED).alias("trained"),
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END + "\n"))).alias("parts"),
        F.transform("turns", lambda t: F.length(head(t))).alias("heads"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("trained", i) | (i == F.col("n")))
    each = talks.select("*", F.explode(ends).alias("example"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("example") - 1), "")
    last, on = F.element_at("parts", F.col("example")), F.element_at("trained", F.col("example"))
    each = each.select("_key", "example", (F.col("example") == F.col("n")).alias("last"), context.alias("context"), last.alias("turn"),
                       F.element_at("heads", F.col("example")).alias("head"), on.alias("on"))
    return each.select(
        F.col("_key").alias(key), "example", "last", F.concat("context", "turn").alias("text"),
        F.when(F.col("on"), F.length("context") + F.col("head")).otherwise(F.length("context") + F.length("turn")).alias("start"),
        F.when(F.col("on"), F.length("turn") - F.col("head") - len(END) - 1).otherwise(0).alias("length"))


def turns_of(text: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    marked = F.split(text, r"<\|im_end\|>\n", -1)
    marked = F.transform(F.slice(marked, F.lit(1), F.size(marked) - 1), lambda t: F.substr(t, F.lit(len(START) + 1)))
    return F.transform(marked, lambda t: F.struct(
        unescape(F.replace(F.substr(t, F.lit(1), F.instr(t, "\n") - 1), F.lit(BREAK), F.lit("\n"))).alias("role"),
        unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text")))


def masked(text: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask as it was before formatting."""
    return unescape(F.substr(text, start + 1, length))
