"""Chat formatting by perspective rotation: every participant of a dialogue in turn is the
assistant, the others are named users, and the mask covers what that participant says.

A long dialogue is rendered in parts of ``block`` turn numbers and, where numbers repeat or are
missing, in pieces of ``block`` turns, so that no row holds all of it; ``char_offset`` places a piece
in the whole, and pieces in order concatenate to it. What is said can't end a turn: the marks that
it holds are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", block: int = 1024
) -> DataFrame:
    """``conv_id, speaker, part, piece, n_turns, char_offset, text, masks``: masks are spans of
    characters of ``text``, from a turn of ``speaker`` to its closing mark, that mark included.

    System turns are rendered as such for everyone and have no perspective of their own; a null
    speaker is ``unknown``, a null text is empty. ``<|`` in texts and names is written ``< |``, and
    line breaks in names are spaces. Turns are in order of number, then speaker, then text; those
    without a number come last, in a part of their own. A row without a conversation id is a
    dialogue of its own. Repeated rows are turns of their own. An empty table gives no row; other
    columns are not looked at.
    """
    plain = lambda c, instead: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(instead)), F.lit("<|"), F.lit("< |"))
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.regexp_replace(plain(speaker_col, UNKNOWN), r"[\r\n]+", " ").alias("by"),
        plain(text_col, "").alias("said"),
    ).withColumn("part", F.floor(F.col("turn") / block))
    alone = said.where("conv_id IS NULL").where(F.col("by") != SYSTEM).withColumn("speaker", F.col("by"))
    said = said.where("conv_id IS NOT NULL")
    order = [F.col("turn").asc_nulls_last(), F.col("by"), F.col("said")]
    said = said.withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1) / block))
    speakers = said.where(F.col("by") != SYSTEM).select("conv_id", F.col("by").alias("speaker")).distinct()
    own = F.col("by") == F.col("speaker")
    role = F.when(own, "assistant").when(F.col("by") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), "by"))
    rendered = {"head": F.concat(F.lit(OPEN), role, F.lit("\n")), "body": F.concat("said", F.lit(CLOSE))}
    size = F.length("head") + F.length("body") + 1
    mask = F.struct((F.col("end") - F.length("body") - 1).alias("start"), (F.col("end") - 1).alias("end"))
    line = F.concat("head", "body", F.lit("\n"))
    each = said.join(speakers, "conv_id").withColumns(rendered)
    keys = ["conv_id", "speaker", "part", "piece"]
    in_piece = Window.partitionBy(*keys).orderBy(*order)
    placed = each.withColumn("end", F.sum(size).over(in_piece.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(in_piece))
    turn = F.struct("place", line.alias("text"), F.when(own, mask).alias("mask"))
    pieces = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max("end").alias("n_chars"))
    earlier = Window.partitionBy("conv_id", "speaker").orderBy(F.col("part").asc_nulls_last(), "piece").rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.select(
        *keys,
        F.size("turns").alias("n_turns"),
        F.coalesce(F.sum("n_chars").over(earlier), F.lit(0)).alias("char_offset"),
        F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("text"),
        F.filter(F.transform("turns", lambda x: x["mask"]), lambda x: x.isNotNull()).alias("masks"),
    )
    alone = alone.withColumns(rendered).withColumn("end", size.cast("long"))
    return out.unionByName(
        alone.select("conv_id", "speaker", "part", F.lit(0).cast("long").alias("piece"), F.lit(1).alias("n_turns"), F.lit(0).cast("long").alias("char_offset"), line.alias("text"), F.array(mask).alias("masks"))
    )
