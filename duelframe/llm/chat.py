"""Perspective rotation: each participant in turn is the assistant of the dialogue, all others are users.

For every participant of a conversation the whole conversation is rendered: its own turns as
``assistant``, other speakers' as ``user`` with their name, system turns as ``system``. The loss mask
covers the assistant's text and its end mark. The result has one row per (conversation, perspective,
turn) with the rendered segment and its place in the rendered dialogue, so the segments of a dialogue,
in order, are the dialogue, and no conversation has to fit into one task: places are running totals
over ranges of turns, joined from sums per range.

Rows that repeat another in everything count once. Turns with the same number are ordered by speaker,
then text; a null number comes first. A null role speaks as ``unknown``; a null text is empty. Rows
without a conversation id form no dialogue and each stands alone, as a conversation of that one turn.
System turns are nobody's perspective: a conversation with no other speaker has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose running totals are built in one window.
RANGE = 256


def _header(as_: str, speaker: Column) -> Column:
    return F.lit(f"<|{as_}|>\n") if as_ != "user" else F.concat(F.lit("<|user:"), speaker, F.lit("|>\n"))


END = "<|end|>\n"


def rotate(turns: DataFrame, system_role: str = "system") -> DataFrame:
    """One row per perspective and turn.

    ``conv_id, perspective, position`` (from 0), ``turn, speaker, shown_as, segment, starts, ends``
    (characters of the rendered dialogue), and ``mask_starts, mask_ends``, null where nothing is
    learnt.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    alone = F.when(F.col("conv_id").isNull(), F.struct("turn", "speaker", "text"))
    said = said.withColumn("alone", F.sha2(F.to_json(alone), 256)).withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / RANGE))
    key = ["conv_id", "alone"]
    system = F.col("speaker") == system_role
    as_user = F.length(F.when(system, _header("system", F.col("speaker"))).otherwise(_header("user", F.col("speaker")))) + F.length("text") + len(END)
    as_assistant = F.length(_header("assistant", F.col("speaker"))) + F.length("text") + len(END)
    sized = said.withColumns({"plain": as_user.cast("long"), "own": as_assistant.cast("long")})

    parts = sized.groupBy(*key, "part", "speaker").agg(F.count("*").alias("n"), F.sum("plain").alias("plain"), F.sum(F.col("own") - F.col("plain")).alias("more"))
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*key, *by).orderBy("part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = parts.groupBy(*key, "part").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"))
    totals = totals.select(*key, "part", before("n").alias("n_before"), before("plain").alias("plain_before"))
    order = ["turn", "speaker", "text"]
    inside = Window.partitionBy(*key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"n_inside": F.count("*").over(inside), "plain_inside": F.coalesce(F.sum("plain").over(inside), F.lit(0))})
    null_safe = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    joined = placed.join(totals, null_safe(placed, totals, [*key, "part"])).select(*[placed[c] for c in [*key, "part", *order, "plain", "own"]], (F.col("n_before") + F.col("n_inside")).alias("position"), (F.col("plain_before") + F.col("plain_inside")).alias("plain_at"))

    speakers = sized.where(~system).select(*key, F.col("speaker").alias("perspective")).distinct()
    shown = joined.join(speakers, null_safe(joined, speakers, key)).select(*[joined[c] for c in joined.columns], "perspective")
    own_parts = parts.select(*key, "part", F.col("speaker").alias("perspective"), "more")
    per_part = own_parts.select(*key, "part", "perspective", before("more", "perspective").alias("more_before"), "more")
    mine = F.col("speaker") == F.col("perspective")
    own_inside = Window.partitionBy(*key, "perspective", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shown = shown.withColumn("more_inside", F.coalesce(F.sum(F.when(mine, F.col("own") - F.col("plain")).otherwise(0)).over(own_inside), F.lit(0)))
    # a range in which the speaker is silent takes the total of the last range before it
    ranges = speakers.join(totals.select(*[totals[c].alias(f"t_{c}") for c in [*key, "part"]]), [speakers[c].eqNullSafe(F.col(f"t_{c}")) for c in key]).select(*key, "perspective", F.col("t_part").alias("part"))
    filled = ranges.join(per_part, null_safe(ranges, per_part, [*key, "part", "perspective"]), "left").select(*[ranges[c] for c in [*key, "part", "perspective"]], F.coalesce("more", F.lit(0)).alias("more"))
    carried = filled.select(*key, "part", "perspective", before("more", "perspective").alias("more_before"))
    out = shown.join(carried, null_safe(shown, carried, [*key, "part", "perspective"])).select(*[shown[c] for c in shown.columns], "more_before")

    starts = F.col("plain_at") + F.col("more_before") + F.col("more_inside")
    shown_as = F.when(mine, "assistant").when(system, "system").otherwise("user")
    header = F.when(mine, _header("assistant", F.col("speaker"))).when(system, _header("system", F.col("speaker"))).otherwise(_header("user", F.col("speaker")))
    segment = F.concat(header, F.col("text"), F.lit(END))
    return out.select(
        "conv_id", "perspective", "position", "turn", "speaker", shown_as.alias("shown_as"), segment.alias("segment"),
        starts.alias("starts"), (starts + F.length(segment)).alias("ends"),
        F.when(mine, starts + F.length(header)).alias("mask_starts"), F.when(mine, starts + F.length(segment)).alias("mask_ends"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """Whole rendered dialogues with their masks, for conversations that fit into a task."""
    part = F.struct("position", "segment", "mask_starts", "mask_ends")
    listed = segments.where("conv_id IS NOT NULL").groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(part)).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["mask_starts"].isNotNull()), lambda x: F.struct(x["mask_starts"].alias("starts"), x["mask_ends"].alias("ends")))
    return listed.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"), spans.alias("mask"))
