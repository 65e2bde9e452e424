"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and the reply as
the only trainable span.  A conversation that does not end with an assistant turn gets one
more example that trains nothing, so that the formatted data hold every turn.

The template opens a turn with ``<|im_start|>role`` and a line feed and closes it with
``<|im_end|>`` and a line feed.  Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\\|``, so no control string can come from the data; in roles a line feed becomes
``\\n``.  The inverse is exact for every string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def escape_role(s: Column) -> Column:
    return F.replace(escape(s), F.lit("\n"), F.lit("\\n"))


def unescape_role(s: Column) -> Column:
    return unescape(F.regexp_replace(s, r"(?<=^|[^\\])((?:\\\\)*)\\n", "$1\n"))


def expand(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv, example, n_turns, whole, text, loss_start, loss_length.

    Offsets count code points from 0 in the formatted text; an example that trains nothing
    has null offsets.  whole marks the example that holds all turns.  Turns go by number,
    null first; equal numbers by role and text, repeated rows kept.  A null role or text is
    empty; a null conversation id is a conversation of its own.  Texts of any length are kept whole, but
    a conversation is one row while it is expanded; other columns are not read whatever their names, and
    an empty table gives an empty result.
    """
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    talks = rows.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(own)).alias("t"))

    def render(t: Column) -> Column:
        head = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
        body = escape(t["text"])
        turn_text = F.concat(head, body, F.lit(END + "\n"))
        return F.struct(
            turn_text.alias("s"), F.char_length(turn_text).alias("n"), F.char_length(head).alias("head"), F.char_length(body).alias("body"), (t["role"] == "assistant").alias("mine")
        )

    talks = talks.withColumn("t", F.transform("t", render))
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i.cast("int"))["mine"] | (i == F.size("t")))
    made = talks.select(conv, "t", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("t", F.col("n_turns"))
    context = F.aggregate(F.slice("t", F.lit(1), F.col("n_turns") - 1), F.lit(0), lambda a, x: a + x["n"])
    return made.select(
        conv,
        "example",
        "n_turns",
        (F.col("n_turns") == F.size("t")).alias("whole"),
        F.array_join(F.transform(F.slice("t", F.lit(1), F.col("n_turns")), lambda x: x["s"]), "").alias("text"),
        F.when(last["mine"], context + last["head"]).alias("loss_start"),
        F.when(last["mine"], last["body"]).alias("loss_length"),
    )


def parse(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    parts = F.split(text, r"<\|im_end\|>\n")
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the examples hold, read back from their texts and masks, by conversation."""
    turns = parse(F.col("text"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.when(F.col("loss_start").isNotNull(), unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_length"))))
    each = examples.select(
        conv,
        "example",
        F.when(F.col("whole"), F.size(turns)).cast("long").alias("n_turns"),
        F.when(F.col("whole"), F.sha2(told, 256)).alias("turns_sha256"),
        trained.alias("trained"),
        F.char_length("text").cast("long").alias("chars"),
    )
    parts = F.filter(F.sort_array(F.collect_list(F.struct("example", "trained"))), lambda x: x["trained"].isNotNull())
    back = each.groupBy(conv).agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.array_join(F.transform(parts, lambda x: x["trained"]), "").alias("all"), F.sum("chars").alias("formatted_chars"))
    return back.select(conv, "n_turns", "turns_sha256", F.char_length("all").cast("long").alias("loss_chars"), F.sha2("all", 256).alias("loss_sha256"), "formatted_chars")
