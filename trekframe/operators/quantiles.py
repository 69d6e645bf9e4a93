"""Running sums over values in ranges, and exact quantiles by distributed selection.

No task holds or orders a group's values. A first pass takes the groups' spans,
a second counts equal-width bins of them (counts are merged, some thousand
numbers a group). The bins that hold the wanted ranks are known then, and only
their values are counted and ordered, in ranges of bounded size.

Defined cases: null and NaN are left out; infinities are values; a group of one
value has it as every quantile; groups with a null key have none; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekframe.sources.shared import materialised

#: Bins of a group.
BINS = 4096
#: Rows of a running sum that one task orders, about.
RANGE_ROWS = 1_000_000


def with_upto(counts: DataFrame, value: str, weight: str, by: tuple[str, ...] = (), range_rows: int | None = None) -> DataFrame:
    """counts with upto: the weight of the group's rows up to each row's value.

    Distinct values may be as many as rows, so no task orders a whole group:
    values are dealt into ranges, the ranges' sums are added up (a row a range),
    and each range is ordered by itself.
    """
    counts = materialised(counts)
    ranges = -(-counts.count() // (range_rows or RANGE_ROWS))
    rows = counts.withColumn("_range", F.lit(0))
    if ranges > 1:
        bounds = counts.groupBy(*by).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("_bounds"))
        rows = counts.join(F.broadcast(bounds), list(by)) if by else counts.join(F.broadcast(bounds))  # a row a group
        rows = rows.withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    sums = rows.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    before = sums.select(*by, "_range", F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.sum(weight).over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", inside).join(F.broadcast(before), [*by, "_range"]).withColumn("upto", F.col("upto") + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def quantiles(values: DataFrame, by: list[str], probabilities: list[float], value: str = "value", bins: int = BINS, range_rows: int | None = None) -> DataFrame:
    """The columns of by, and q: the quantiles in the order of the probabilities, interpolated linearly between the ranks next to p (n - 1)."""
    known = values.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    spans = known.groupBy(*by).agg(F.count("*").alias("_n"), F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    # Halves, as the span of large numbers may not be a number.
    share = F.try_divide(F.col("_v") / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2)
    bin_ = F.when(F.col("_v") == float("inf"), bins).when(F.col("_v") == -float("inf"), -1).otherwise(F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)))
    binned = _joined(known, spans, by).withColumn("_bin", bin_.cast("long"))
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin"))  # some thousand rows a group
    counts = counts.withColumn("_upto", upto).withColumn("_skipped", F.col("_upto") - F.col("_c")).drop("_c")

    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at")) for i, p in enumerate(probabilities)])
    wanted = spans.select(*by, F.inline(places)).select(*by, "i", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("_rank"))
    wanted = _joined(wanted, counts, by).where((F.col("_skipped") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))).select(*by, "i", "at", "_rank", "_bin", "_skipped")
    opened = wanted.select(*by, "_bin", "_skipped").distinct()
    inside = _joined(binned.select(*by, "_bin", "_v"), opened, [*by, "_bin"]).groupBy(*by, "_bin", "_skipped", "_v").agg(F.count("*").alias("_c"))
    ordered = with_upto(inside, "_v", "_c", (*by, "_bin"), range_rows)
    last = F.col("_skipped") + F.col("upto")
    ordered = ordered.select(*by, "_bin", "_v", (last - F.col("_c")).alias("_first"), last.alias("_next"))
    found = _joined(wanted.drop("_skipped"), ordered, [*by, "_bin"]).where((F.col("_first") <= F.col("_rank")) & (F.col("_rank") < F.col("_next")))
    low, part = F.min_by("_v", "_rank"), F.max("at") - F.floor(F.max("at"))
    each = found.groupBy(*by, "i").agg(F.when(low == F.max_by("_v", "_rank"), low).otherwise((1 - part) * low + part * F.max_by("_v", "_rank")).alias("_q"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "_q"))).alias("_qs")).select(*by, F.transform("_qs", lambda s: s["_q"]).alias("q"))


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.crossJoin(right)  # without groups one side is a row, or a row a bin
