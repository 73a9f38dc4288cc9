"""Multi-party dialogues from every participant's point of view, in DataFrame operations only.

For each participant the whole dialogue is rendered once: that speaker's turns as the
assistant, everyone else's as users with their names, turns of ``CONTEXT`` roles as they
are, and the spans to train on are the assistant's own words with their end mark.

Long dialogues come in parts of ``PART_TURNS`` turns, so no row or task holds more than that of
one conversation; an ordinary one is a single part. Turns are numbered by (turn, speaker,
text), nulls first, with the group-size-safe numbering of ``operators.ordered``. The output
holds turns x participants rows at most, as the task asks for.

Null text is an empty turn and a null role the speaker ``unknown``; rows without a
conversation id form one conversation of their own. Repeated rows are repeated turns. A
conversation of nothing but context turns has no participant and gives no row, nor does
an empty table. The start of a control mark inside a text is written apart, so no text
can forge a turn. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.ordered import number_rows

PART_TURNS = 256
CONTEXT = ("system",)
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"


def _head(message: Column, perspective: Column) -> Column:
    named = F.concat(F.lit(f"{START}user name="), message["speaker"], F.lit("\n"))
    return (
        F.when(message["speaker"] == perspective, F.lit(f"{START}assistant\n"))
        .when(message["speaker"].isin(*CONTEXT), F.concat(F.lit(START), message["speaker"], F.lit("\n")))
        .otherwise(named)
    )


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Rows (conv_id, perspective, part, n_turns, n_target, text, masks) of (conv_id, turn, role, text).

    ``masks`` holds [start, end) spans of ``text`` in code points.
    """
    clean = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("turn", "speaker", "text")]
    placed = number_rows(clean, ["conv_id"], order, "n")
    parts = (
        placed.withColumn("part", F.floor((F.col("n") - 1) / part_turns))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("n", "speaker", "text"))).alias("messages"))
    )
    speakers = (
        clean.where(~F.col("speaker").isin(*CONTEXT))
        .select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))
    own = F.col("perspective")
    pieces = F.transform(
        "messages",
        lambda m: F.struct(
            _head(m, own).alias("head"),
            F.concat(m["text"], F.lit(END)).alias("body"),
            (m["speaker"] == own).alias("target"),
        ),
    )
    seen = seen.withColumn("pieces", pieces)
    # Each message's end in the rendered text, by one pass that carries the last end.
    walk = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda state, p: F.struct(
            (state["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(
                p["target"],
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + F.length(p["head"])).alias("start"),
                            (state["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )
    return seen.select(
        "conv_id",
        "perspective",
        F.col("part").cast("long").alias("part"),
        F.size("messages").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["target"])).cast("long").alias("n_target"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        walk["spans"].alias("masks"),
    )
