"""Chat formatting: every participant's view of a dialogue, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def _plain(text: Column) -> Column:
    """Text that can't be taken for a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_role: str = "system", block_turns: int = 256) -> DataFrame:
    """One row per conversation, speaker and turn: the turn as it reads when the speaker is the assistant.

    Columns: conversation, speaker, position (from 0), turn, role, rendered, seg_start and seg_end
    (its place in the speaker's whole rendering, in code points, end exclusive), trained (the
    speaker's own turn) and mask_start, mask_end (the text and end marker to train on; null in
    other turns). The rendering of a conversation for a speaker is its rows' `rendered`, joined
    by position; rows keep conversations of any length spread over tasks.

    Every role but system_role is a participant and gets a view; others are users with their
    names; system turns are shown to all. Turns go by number, nulls last, then role, then text.
    Places are prefix sums in two steps: inside blocks of block_turns turn numbers, then over
    block totals. Null or blank roles are "unknown"; null text is empty; "<|" in texts and roles
    becomes "< |" and line ends in roles spaces; repeated rows are turns of their own; a
    conversation of system turns only, and an empty table, give no rows; texts of any length are rendered whole, a turn in one row; a null conversation is
    one like others; other columns don't matter.
    """
    role = F.when(F.coalesce(F.col(role_col), F.lit("")).rlike(r"^[ \t\n\x0B\f\r]*$"), F.lit("unknown")).otherwise(F.col(role_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.translate(_plain(role), "\r\n", "  ").alias("role"), _plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    # Both sides of each join are plain tables and what follows is dealt anew, so AQE can split a hot conversation.
    speakers = staged(rows.where(F.col("role") != system_role).select(F.col("conv").alias("__conv"), F.col("role").alias("speaker")).distinct())
    rows = rows.join(speakers, F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv")

    own = F.col("role") == F.col("speaker")
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(F.col("role") == system_role, F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), "role", F.lit("\n")))
    rows = rows.withColumns({"head": head, "trained": own}).withColumns({"rendered": F.concat("head", "text", F.lit("<|im_end|>\n")), "head_size": F.length("head")}).withColumn("size", F.length("rendered").cast("long")).drop("head")
    rows = rows.withColumn("block", F.struct(F.col("turn").isNull().alias("no_turn"), F.floor(F.col("turn") / block_turns).alias("no"), F.when(F.col("turn").isNull(), F.col("role")).alias("role")))

    view = ["conv", "speaker"]
    blocks = rows.groupBy(*view, "block").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"))
    upto = Window.partitionBy(*view).orderBy("block")
    blocks = staged(blocks.select(F.col("conv").alias("__conv"), F.col("speaker").alias("__speaker"), F.col("block").alias("__block"), (F.sum("n").over(upto) - F.col("n")).alias("n_before"), (F.sum("sizes").over(upto) - F.col("sizes")).alias("size_before")))
    rows = rows.repartition("conv", "speaker", "block")
    here = Window.partitionBy(*view, "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumns({"no": F.row_number().over(here), "inside": F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.join(blocks, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("speaker") == F.col("__speaker")) & F.col("block").eqNullSafe(F.col("__block")))
    start = F.col("size_before") + F.col("inside") - F.col("size")
    rows = rows.withColumns({"position": (F.col("n_before") + F.col("no") - 1).cast("long"), "seg_start": start, "seg_end": start + F.col("size")})
    # A newline closes each turn; it isn't trained on.
    mask = lambda c: F.when(F.col("trained"), c)
    return rows.select(F.col("conv").alias(conv_col), "speaker", "position", F.col("turn").alias(turn_col), F.col("role").alias(role_col), "rendered", "seg_start", "seg_end", "trained", mask(F.col("seg_start") + F.col("head_size")).alias("mask_start"), mask(F.col("seg_end") - 1).alias("mask_end"))
