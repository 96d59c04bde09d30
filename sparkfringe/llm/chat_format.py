"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all preceding turns are context, and only the
text of that reply is trainable. A conversation that doesn't end with an assistant turn gets one more
example without a trainable span, so that no turn is lost.

Turns are marked ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles, ``<|`` would read as
a mark; each run ``<``, backslashes, ``|`` therefore gets one more backslash, which
:func:`unescape` takes off again. Roles also write ``%`` and line feeds as ``%25`` and ``%0A``.

Null texts and roles count as empty; rows of one conversation go by turn (nulls first), then role,
then text; repeated rows are turns of their own; a null conv_id is one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, target, n_context, formatted, loss_start, loss_length).

    ``target`` is the place (from 0) of the trained turn; null in an example without one. The loss
    span counts code points of ``formatted``.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.select(
        "conv_id",
        F.col("turns.role").alias("roles"),
        F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
    )
    last = F.size("roles") - 1
    places = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("roles", i) == TARGET_ROLE) | (i == last))
    each = whole.select("*", F.explode(places).alias("at"))
    context = F.transform(
        F.slice("heads", F.lit(1), F.col("at")),
        lambda head, i: F.concat(head, F.get("texts", i), F.lit(f"{END}\n")),
    )
    hit = F.get("roles", F.col("at")) == TARGET_ROLE
    each = each.select(
        "conv_id",
        F.when(hit, F.col("at")).alias("target"),
        F.col("at").alias("n_context"),
        F.concat(F.array_join(context, ""), F.get("heads", F.col("at"))).alias("before"),
        F.get("texts", F.col("at")).alias("reply"),
    )
    hit = F.col("target").isNotNull()
    return each.select(
        "conv_id",
        "target",
        "n_context",
        F.concat("before", "reply", F.lit(f"{END}\n")).alias("formatted"),
        F.when(hit, F.length("before")).cast("long").alias("loss_start"),
        F.when(hit, F.length("reply")).otherwise(0).cast("long").alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, array<struct<role, text>>, unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.substr(x, F.lit(len(START) + 1))
    )

    def turn(body: Column) -> Column:
        cut = F.instr(body, "\n")
        return F.struct(
            unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substr(body, cut + 1)).alias("text"),
        )

    return F.transform(bodies, turn)


def digests(examples: DataFrame) -> DataFrame:
    """What each conversation's examples say, read back from them: one row per conversation."""
    masked = F.when(
        F.col("target").isNotNull(), F.expr("substr(formatted, loss_start + 1, loss_length)")
    )
    found = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_context").alias("longest"),
        F.array_sort(F.collect_list(F.when(masked.isNotNull(), F.struct("target", masked.alias("text"))))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    found = found.select(
        "conv_id",
        parse(F.col("longest")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: unescape(x["text"])), "").alias("loss"),
        "formatted_chars",
    )
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
