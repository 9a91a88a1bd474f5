"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation is rendered once as one string. Every turn has an opening and a closing mark::

    <s>[INST] user text [/INST]      [ANS] assistant text </s>      [ROLE:<hex of role>] other text [/ROLE]

Every assistant turn is one training example: its context is the rendering up to and including ``[ANS] ``, its target
the escaped reply, and only the target is trainable. As the context of an example is a prefix of the rendering, an
example is stored as a length of it; ``with_context`` cuts out the texts, whose total size is quadratic in the turns.

Control strings inside texts get one backslash after their first character, and so do those that already have some
there; taking one backslash away restores the text.

Rows: a null text or role counts as empty; rows of a conversation go by turn, then role, then text, so that ties and
repeated rows have one order and are kept; rows without conv_id form one conversation with a null id. An empty table
gives no rows. Columns besides conv_id, turn, role and text are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = r"/?s>|/?INST\]|ANS\]|ROLE:|/ROLE\]"
TURN = r"(?s)<s>\[INST\] .*? \[/INST\]|\[ANS\] .*? </s>|\[ROLE:[0-9A-F]*\] .*? \[/ROLE\]"
USER, REPLY = ("<s>[INST] ", " [/INST]"), ("[ANS] ", " </s>")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def render_turn(role: Column, text: Column) -> Column:
    """One turn with its marks; role and text must not be null."""
    other = (F.concat(F.lit("[ROLE:"), F.hex(F.encode(role, "UTF-8")), F.lit("] ")), F.lit(" [/ROLE]"))
    mark = lambda i: F.when(role == "user", F.lit(USER[i])).when(role == "assistant", F.lit(REPLY[i])).otherwise(other[i])
    return F.concat(mark(0), escape(text), mark(1))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: the rendering of each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), "").alias("formatted"))
    )


def expand(formatted: DataFrame) -> DataFrame:
    """One row per turn, read back from the rendering: conv_id, position, role, text, trainable, example (number of the
    reply in its conversation, null for other turns), context_chars and target (the escaped reply under the loss mask)
    for replies, and formatted_chars."""
    opening = F.regexp_extract("segment", r"^(?:<s>\[INST\] |\[ANS\] |\[ROLE:[0-9A-F]*\] )", 0)
    closing = F.when(F.col("opening") == USER[0], len(USER[1])).when(F.col("opening") == REPLY[0], len(REPLY[1])).otherwise(len(" [/ROLE]"))
    body = F.substring(F.col("segment"), F.length("opening") + 1, F.length("segment") - F.length("opening") - closing)
    role = F.when(F.col("opening") == USER[0], "user").when(F.col("opening") == REPLY[0], "assistant")
    other = F.decode(F.unhex(F.regexp_extract("opening", r"ROLE:([0-9A-F]*)", 1)), "UTF-8")
    before = Window.partitionBy("conv_id").orderBy("position")
    return (
        formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.posexplode(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))).alias("position", "segment"))
        .withColumn("opening", opening)
        .withColumn("body", body)
        .withColumn("trainable", F.col("opening") == REPLY[0])
        .withColumn("end", F.sum(F.length("segment").cast("long")).over(before))
        .withColumn("example", F.when(F.col("trainable"), F.sum(F.col("trainable").cast("long")).over(before) - 1))
        .select(
            "conv_id", "position", F.coalesce(role, other).alias("role"), unescape(F.col("body")).alias("text"), "trainable", "example",
            F.when(F.col("trainable"), F.col("end") - F.length("segment") + F.length("opening")).alias("context_chars"),
            F.when(F.col("trainable"), F.col("body")).alias("target"), "formatted_chars",
        )
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, context_chars, target."""
    return expand(formatted).filter("trainable").select("conv_id", "example", "context_chars", "target")


def with_context(formatted: DataFrame) -> DataFrame:
    """``examples`` with the context written out; its characters grow with the square of a conversation's turns."""
    found = examples(formatted).withColumnRenamed("conv_id", "of")
    return formatted.join(found, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "example", F.expr("substring(formatted, 1, int(context_chars))").alias("context"), "target"
    )


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation: what can be read back from its rendering and its examples; ``n_examples`` and the total
    length of their contexts, ``context_chars``, come from the expansion."""
    turn = F.struct("position", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"))
    reply = F.when(F.col("trainable"), F.struct("example", unescape(F.col("target")).alias("text")))
    joined = lambda c, field: F.array_join(F.transform(F.sort_array(c), lambda x: x[field]), "")
    return (
        expand(formatted)
        .groupBy("conv_id")
        .agg(F.count("*").alias("n_turns"), F.max("formatted_chars").alias("formatted_chars"), F.collect_list(turn).alias("turns"), F.collect_list(reply).alias("replies"),
            F.count("example").alias("n_examples"), F.coalesce(F.sum("context_chars"), F.lit(0)).cast("long").alias("context_chars"))
        .select("conv_id", "n_turns", F.sha2(joined("turns", "turn"), 256).alias("turns_sha256"), joined("replies", "text").alias("loss"), "formatted_chars", "n_examples", "context_chars")
        .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "context_chars")
    )
