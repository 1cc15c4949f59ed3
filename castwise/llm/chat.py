"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant the dialogue is rendered once with that speaker as
``assistant``, the other speakers as named users and narrators (``system``)
as they are. Only the assistant's own turns are training targets.

A rendering is returned as segments, one row per turn, with the character
place of the turn and of its target span in the whole rendering. Places are
running sums in two levels (within ranges of ``RANGE`` turns, and over the
ranges), so a very long dialogue is never gathered in one task; ``assemble``
joins up to ``PART`` consecutive segments into one text with mask spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
RANGE = 512
PART = 128


def escape(text: Column) -> Column:
    """A text that cannot open or close a turn: ``<|`` is written ``< |``."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """(conv_id, perspective, position, turn, speaker, segment, start, length, is_target, target_start, target_end).

    One row per dialogue, participant and turn. Turns are ordered by number,
    then speaker, then text, nulls first; position counts them from 0. Turns
    that are equal in all four columns are one turn. A null text is an empty
    turn, a null speaker an unnamed one that takes no perspective of its own;
    rows with a null conv_id belong to no dialogue and are left out. A dialogue
    of narrators only has no participant and gives no row. Other columns are
    not read. target_start and target_end (exclusive, 0 if not a target) frame
    the turn's text and closing mark.
    """
    t = (turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(speaker).alias("speaker"), F.col(text).alias("text"))
         .where(F.col("conv_id").isNotNull()).withColumn("range", F.floor(F.coalesce("turn", F.lit(0)) / RANGE))
         .repartition("conv_id", "range").distinct())  # the one exchange of the texts: all that follows keeps it
    narrator = F.coalesce(F.col("speaker").isin(*narrators), F.lit(False)) if narrators else F.lit(False)
    head = (F.when(narrator, F.col("speaker")).when(F.col("speaker").isNull(), F.lit("user"))
            .otherwise(F.concat(F.lit("user name="), escape(F.col("speaker")))))
    mark = lambda h: F.concat(F.lit(OPEN), h, F.lit("\n"))
    t = t.withColumn("other", mark(head)).withColumn("body", F.concat(escape(F.col("text")), F.lit(CLOSE)))

    # characters and turns before each range, seen by each participant: from the counts of its speakers
    said = t.groupBy("conv_id", "range", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("other") + F.length("body")).alias("chars"),
                                                        F.first("other").alias("other"))
    whole = said.groupBy("conv_id", "range").agg(F.sum("n").alias("turns"), F.sum("chars").alias("chars"))
    who = said.where(F.col("speaker").isNotNull() & ~narrator).groupBy("conv_id", F.col("speaker").alias("perspective")).agg(
        (F.length(mark(F.lit("assistant"))) - F.length(F.first("other"))).alias("change"))
    own = said.select("conv_id", "range", F.col("speaker").alias("perspective"), F.col("n").alias("own"))
    seen = (whole.join(who, "conv_id").join(own, ["conv_id", "range", "perspective"], "left")
            .withColumn("chars", F.col("chars") + F.coalesce("own", F.lit(0)) * F.col("change")))
    running = "over (partition by conv_id, perspective order by range rows between unbounded preceding and current row)"
    before = seen.select("conv_id", "range", "perspective", F.expr(f"sum(chars) {running} - chars").alias("chars_before"),
                         F.expr(f"sum(turns) {running} - turns").alias("turns_before"))

    order = "partition by conv_id, range order by turn, speaker, text rows between unbounded preceding and current row"
    me = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    both = (t.withColumn("nth", F.expr(f"count(1) over ({order})")).join(before, ["conv_id", "range"])
            .withColumn("mark", F.when(me, mark(F.lit("assistant"))).otherwise(F.col("other")))
            .withColumn("segment", F.concat("mark", "body")).withColumn("length", F.length("segment").cast("long"))
            .withColumn("inside", F.expr("sum(length) over (partition by conv_id, range, perspective order by nth rows between unbounded preceding and current row) - length")))
    start = F.col("chars_before") + F.col("inside")
    return both.select(
        "conv_id", "perspective", (F.col("turns_before") + F.col("nth") - 1).cast("long").alias("position"), "turn", "speaker", "segment",
        start.cast("long").alias("start"), "length", me.alias("is_target"),
        F.when(me, start + F.length("mark")).otherwise(F.lit(0)).cast("long").alias("target_start"),
        F.when(me, start + F.col("length")).otherwise(F.lit(0)).cast("long").alias("target_end"))


def assemble(segments: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, first_char, n_turns, text, spans): parts of ``part`` consecutive turns.

    ``text`` joins the part's segments, ``spans`` holds its targets as
    (start, end) within the text. A group has at most ``part`` rows.
    """
    row = F.struct("position", "start", "segment", "is_target", "target_start", "target_end")
    g = (segments.withColumn("part", F.floor(F.col("position") / part).cast("long")).groupBy("conv_id", "perspective", "part")
         .agg(F.sort_array(F.collect_list(row)).alias("s")))
    first = F.col("s")[0]["start"]
    spans = F.transform(F.filter("s", lambda x: x["is_target"]), lambda x: F.struct((x["target_start"] - first).alias("start"), (x["target_end"] - first).alias("end")))
    return g.select("conv_id", "perspective", "part", first.alias("first_char"), F.size("s").alias("n_turns"), F.array_join("s.segment", "").alias("text"), spans.alias("spans"))
