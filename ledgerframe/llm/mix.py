"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source follows a piecewise linear weight schedule over training time 0..1. Its integral is
the source's weight; the weights share out the words to be taken, and a target stops at ``cap``
times its source's words, the excess being shared again by weight. Within a source, documents
follow one another in the order of a hash of their id, again and again until the target is
filled; the word at offset u of a source whose target is T is wanted at the time t at which the
schedule's integral reaches u / T of its whole (the inverse of the cumulative demand). Documents
are then range-sorted by that position.

The running word counts need no pass over a whole source in one task: words are summed by
(source, first hex digits of the hash), those sums are accumulated (at most 4096 per source), and
each such bucket is accumulated by itself.

Defined results: a null or empty text has size 0, takes 0 words and has no position. Null sources
form one source that sorts last. A source without words has target 0. Rows with equal ids are
taken as different documents in the order of their size; columns other than doc_id, source and
text are carried through by ``mixed`` and ignored elsewhere. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, cut, text_or_empty, unused

#: Knots (time, weight) of each schedule; sources by code point take them in turn. Integrals: 1, 2, 3;
#: three neighbours weigh 6 together at any time, so that time runs with the words taken (until caps bind).
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 4.0), (0.5, 3.0), (1.0, 2.0)))
CAP = 3
BUCKET_DIGITS = 3


def integral(schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def invert(schedule, share: Column) -> Column:
    """The time at which the integral of ``schedule`` reaches ``share`` (0..1) of its whole."""
    whole, done, found = integral(schedule), 0.0, None
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        rest = share * F.lit(whole) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        # area up to t0 + x is w0 x + slope x^2 / 2; the root in the form that is stable at slope 0
        inside = F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * rest)
        x = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + F.sqrt(inside))
        found = F.when(share * F.lit(whole) <= F.lit(done + area), x) if found is None else found.when(share * F.lit(whole) <= F.lit(done + area), x)
        done += area
    return F.least(F.lit(1.0), found.otherwise(F.lit(1.0)))


def targets(sources: DataFrame, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, kind (index of its schedule), target.

    Sharing again until no target exceeds its cap has one fixed point: in the order of cap over
    weight a first run of sources is capped, the rest share what is left by weight.
    """
    weights = [round(integral(s), 12) for s in schedules]
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(by_name) - 1) % F.lit(len(schedules))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("kind") + 1)
    ranked = sources.withColumn("kind", kind).withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("kind"), F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shared = (
        ranked.withColumn("left_words", F.sum("source_size").over(whole) - F.lit(cap) * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("place", F.row_number().over(order))
    )
    fits = F.col("weight") * F.col("left_words") <= F.lit(cap) * F.col("source_size") * F.col("left_weight")
    level = shared.withColumn("first", F.min(F.when(fits, F.struct("place", "left_words", "left_weight"))).over(whole))
    target = (
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .when(F.col("place") >= F.col("first.place"), F.col("weight") * F.col("first.left_words") / F.col("first.left_weight"))
        .otherwise(F.col("source_size") * F.lit(float(cap)))
    )
    return level.select("source", "source_size", "kind", target.alias("target"))


def measured(docs: DataFrame) -> DataFrame:
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty())))  # null ids spread by their text
    return docs.select(
        "doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long").alias("size"), order.alias("ord"), F.substring(order, 1, BUCKET_DIGITS).alias("bucket")
    )


def plan_mix(docs: DataFrame, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies.

    ``copies`` lists (words, position) of each copy that the mix takes, in order; ``taken`` sums its
    words. A source's taken words add up to its target, rounded down, so that at most one copy of
    one document of a source is taken in part.
    """
    sized = cut(measured(docs), "mix-sizes")
    sums = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, cap)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    s, g = sums.withColumn("bucket_start", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("s"), goals.alias("g")
    offsets = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "s.bucket", "bucket_start", "source_size", "kind", "target")
    within = Window.partitionBy("source", "bucket").orderBy("ord", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    d, o = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("d"), offsets.alias("o")
    placed = d.join(o, (F.col("d.bucket") == F.col("o.bucket")) & F.col("d.source").eqNullSafe(F.col("o.source"))).select(
        "d.doc_id", "d.source", "d.size", "source_size", "kind", "target", (F.col("bucket_start") + F.col("inner")).alias("start")
    )
    copies = []
    for k in range(cap):
        at = F.col("start") + F.lit(k) * F.col("source_size")
        words = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.floor("target") - at))
        share = (at + words / F.lit(2.0)) / F.col("target")
        copies.append(F.struct(words.alias("words"), F.when(words > 0, _by_kind(schedules, share)).alias("position")))
    placed = placed.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies")


def _by_kind(schedules, share: Column) -> Column:
    out = F.when(F.col("kind") == 0, invert(schedules[0], share))
    for k, s in enumerate(schedules[1:], 1):
        out = out.when(F.col("kind") == k, invert(s, share))
    return out


def range_sorted(df: DataFrame) -> DataFrame:
    """Sorted by position over all partitions; documents without one come last."""
    return df.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def mixed(docs: DataFrame, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, once per copy taken, range-sorted.

    Documents stay whole: the copy that ends a target is kept if at least half of it is taken.
    """
    plan = plan_mix(docs, schedules, cap)
    plan = plan.withColumn("copies", F.filter("copies", lambda c: c["words"] * 2 >= F.col("size"))).filter(F.size("copies") > 0)
    i, s, z, c, r, n, nth, copy = unused(docs, "i", "s", "z", "c", "r", "n", "nth", "copy")
    plan = plan.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(z), F.col("copies").alias(c))
    # Rows listed again with the same id, source and size share one plan entry each.
    again = Window.partitionBy(i, s, z).orderBy(c)
    plan = plan.withColumn(r, F.row_number().over(again))
    sized = docs.withColumn(n, F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long"))
    sized = sized.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", n).orderBy("text")) if _repeats(docs) else F.lit(1))
    on = sized["doc_id"].eqNullSafe(plan[i]) & sized["source"].eqNullSafe(plan[s]) & (sized[n] == plan[z]) & (sized[nth] == plan[r])
    rows = sized.join(plan, on).withColumn(copy, F.explode(c))
    return rows.orderBy(F.col(copy)["position"], F.col("doc_id").asc_nulls_last()).select(*[rows[k] for k in docs.columns])


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
