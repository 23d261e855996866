"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each row has a path of hash digits: 36 bits of its id's, then 13 of its text's, then 13 of its place in the table. Words
are summed by source and leading digit; the running sum finds the digit where a source's budget is crossed, and only that
digit's rows are summed again by their next digit. The outcome is a threshold per source: budgets nest, so a larger one
keeps all rows of a smaller one, and no row is sorted. A source that is to give more than it has gives every row once and
those under the threshold twice. Unique ids are told apart by their own hash; the last digits matter only where a budget
ends among rows that repeat an id, or id and text, and which of equal rows are taken makes no difference.

Targets: sources in code point order (null last) weigh `weights`, repeating. They share `share` of all words; no target
is above `repeat` times its source's words, and what is above is shared again by weight. The final water level is found
in one pass over the sources, ordered by words per weight.

Null and empty texts have size 0 and are never taken; a null source is a source; a null id is hashed as an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of each digit; the first three are the id's, the others the text's and the place's.
DIGITS = (12, 12, 12, 13, 13)
ID_BITS = sum(DIGITS[:3])


def id_hash(column: str) -> Column:
    """The first ID_BITS of the id's MD5 as a long."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, ID_BITS // 4), 16, 10).cast("long")


def path(id_col: str, text_col: str) -> Column:
    """All digits as one long of 62 bits."""
    digit = lambda x, n: F.pmod(x, F.lit(1 << n))
    text, place = digit(F.xxhash64(text_col), DIGITS[3]), digit(F.xxhash64(F.monotonically_increasing_id()), DIGITS[4])
    return F.shiftleft(id_hash(id_col), DIGITS[3] + DIGITS[4]) + F.shiftleft(text, DIGITS[4]) + place


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, repeat: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    ranked = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "utf-8")).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(repeat))
    full = (
        ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", F.try_divide(F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    )
    return full.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"))


def mix(
    documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeat: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) of every row; `repeat` of at most 2.

    The slim rows (no text) are written to the shared folder once; each level of the histogram reads those.
    """
    out = _mixed(documents, F.col(id_col).alias("doc_id"), weights, share, repeat, id_col, text_col, source_col)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(
    documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeat: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of `documents` (all columns), each as often as the mix takes it: not at all, once or twice."""
    out = _mixed(documents, F.struct("*").alias("row"), weights, share, repeat, id_col, text_col, source_col).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def _mixed(documents: DataFrame, carried: Column, weights: tuple[float, ...], share: float, repeat: float, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The carried column, size, source, source_size, target and copies of every row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    slim = stored(documents.select(carried, F.col(source_col).alias("source"), size.alias("size"), path(id_col, text_col).alias("h")), "sizes")
    goals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat)
    # what the threshold has to give: beyond one copy of everything where the target is above that
    goals = stored(goals.withColumn("twice", F.col("target") > F.col("source_size")).withColumn("goal", F.when(F.col("twice"), F.col("target") - F.col("source_size")).otherwise(F.col("target"))), "goals")

    state = goals.select(F.col("source").alias("s"), "goal", F.lit(0).cast("long").alias("lead"), F.lit(0).cast("long").alias("below"))
    for level, bits in enumerate(DIGITS, 1):
        left = sum(DIGITS[level:])
        inside = slim.where("size > 0").select("source", "size", "h").join(state, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", left + bits) == F.col("lead")))
        sums = inside.groupBy("s", "goal", "below", F.shiftright("h", left).alias("digit")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("s").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        summed = sums.withColumn("upto", F.col("below") + F.sum("words").over(run))
        crossing = F.col("upto") > F.col("goal")
        found = summed.groupBy("s").agg(F.min(F.when(crossing, F.struct("digit", (F.col("upto") - F.col("words")).alias("below"), "upto"))).alias("at"))
        state = state.select("s", "goal").join(found.withColumnRenamed("s", "f"), F.col("s").eqNullSafe(F.col("f")), "left").select(
            "s", "goal", F.coalesce("at.digit", F.lit(1 << sum(DIGITS[:level]))).alias("lead"), F.coalesce("at.below", F.lit(0)).alias("below"), F.col("at.upto").alias("upto"),
        )
        state = stored(state, "thresholds")
    # the last digit is taken as a whole where that is nearer to the goal
    limit = F.col("lead") + F.when(F.col("upto") - F.col("goal") <= F.col("goal") - F.col("below"), 1).otherwise(0)
    cut = state.select("s", limit.alias("cut")).join(goals, F.col("s").eqNullSafe(F.col("source"))).select("s", "cut", "source_size", "target", "twice")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("twice").cast("int") + (F.col("h") < F.col("cut")).cast("int"))
    return slim.join(cut, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies).drop("s", "cut", "twice", "h")
