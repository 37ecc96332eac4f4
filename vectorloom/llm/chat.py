"""Chat formatting by event sourcing, DataFrame functions only.

A log holds events ``(conv_id, seq, kind, turn, role, text)``. Partitioned by conversation (a long one by blocks of turns),
sorted by sequence, the events are folded into final messages, which are rendered with a template that marks
turns. Control strings inside texts are escaped reversibly, so the rendered text can be read back.

Kinds: ``message`` opens a message of its own turn with its text; ``delta`` appends text to the turn's current message;
``edit`` replaces what the message says; ``regenerate`` starts its text anew. An event of another kind, or a null one, is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a conversation that are folded and rendered together; longer conversations are spread over tasks.
BLOCK = 64
#: The role whose texts are under the loss mask.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Insert one backslash into every ``<\\...\\|``, so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Undo :func:`escape`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As :func:`escape`, and on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Final messages ``(conv_id, block, turn, n, role, text)``; ``n`` numbers the messages of a turn.

    Events of a turn are taken by (seq, role, text), nulls first, so ties and repeated rows have a fixed order and repeated
    ``message`` events stay separate messages. A null turn comes first, a null role or text counts as empty, and a message has the role of
    its first event. One exchange serves the whole fold; its key is (conversation, block of turns).
    """
    turn = F.col("turn").cast("bigint")
    known = F.col("kind").isin("message", "delta", "edit", "regenerate")
    kind = F.when(F.coalesce(known, F.lit(False)), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of chat event: "), F.coalesce("kind", F.lit("null"))))
    )
    rows = events.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.floor(turn / block).alias("block"),
        turn.alias("turn"),
        F.col("seq").cast("bigint").alias("seq"),
        kind.alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id", "block")
    place = Window.partitionBy("conv_id", "block", "turn").orderBy("seq", "role", "text")
    upto = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        rows.withColumn("pos", F.row_number().over(place))
        .withColumn("n", F.sum((F.col("kind") == "message").cast("int")).over(upto))
        .withColumn("version", F.sum((F.col("kind") != "delta").cast("int")).over(upto))
    )
    pieces = F.sort_array(F.collect_list(F.struct("pos", "text")))
    versions = numbered.groupBy("conv_id", "block", "turn", "n", "version").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), F.min(F.struct("pos", "role")).alias("first")
    )
    return versions.groupBy("conv_id", "block", "turn", "n").agg(
        F.min("first")["role"].alias("role"), F.max(F.struct("version", "text"))["text"].alias("text")
    )


def render(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Rendered blocks ``(conv_id, block, formatted, loss)``.

    ``loss`` holds (start, length) of each text under the loss mask, in code points of ``formatted``, from 0. The blocks of a
    conversation, in order, make up its text; see :func:`conversations`.
    """
    text = escape(F.col("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = messages.select(
        "conv_id", "block", F.struct("turn", "n", head.alias("head"), text.alias("body"), (F.col("role") == loss_role).alias("loss")).alias("m")
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    tail = f"{END}\n"
    formatted = F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit(tail))), "")
    empty = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.aggregate(
        "ms",
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["head"]) + F.length(m["body"]) + len(tail)).alias("at"),
            F.when(
                m["loss"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(m["head"])).alias("start"), F.length(m["body"]).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return blocks.select("conv_id", "block", formatted.alias("formatted"), spans.alias("loss"))


def conversations(blocks: DataFrame) -> DataFrame:
    """One row per conversation: ``(conv_id, formatted, loss)``, the mask as (start, length) in the whole text.

    The text of a conversation is one value, so its blocks meet in one task; before that they are spread.
    """
    parts = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "formatted", "loss"))).alias("parts"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate(
        "parts",
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["formatted"])).alias("at"),
            F.concat(
                acc["spans"],
                F.transform(
                    p["loss"],
                    lambda s: F.struct((acc["at"] + s["start"]).alias("start"), s["length"].cast("bigint").alias("length")),
                ),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"), spans.alias("loss"))


def read_back(blocks: DataFrame) -> DataFrame:
    """What rendered blocks say: ``(conv_id, block, turns, loss_text, formatted_chars)``.

    ``turns`` has (role, text) of every message, ``loss_text`` the texts under the mask without anything between; all unescaped.
    """
    raw = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>", -1)) - 1, F.lit(0)))

    def turn(message: Column) -> Column:
        at = F.instr(message, "\n")
        length = F.length(message) - at - len(END) - 1
        return F.struct(
            unescape_role(F.substring(message, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(message, at + 1, length)).alias("text"),
        )

    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return blocks.select(
        "conv_id", "block", F.transform(raw, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").alias("formatted_chars")
    )


def digests(read: DataFrame) -> DataFrame:
    """Per conversation the counts and SHA-256 digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select(
        "conv_id", F.struct("block", said.alias("said"), "loss_text").alias("p"), F.size("turns").alias("n"), "formatted_chars"
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("p")).alias("ps"), F.sum("formatted_chars").alias("formatted_chars")
    )
    said = F.array_join(F.transform("ps", lambda p: p["said"]), "")
    loss = F.array_join(F.transform("ps", lambda p: p["loss_text"]), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
