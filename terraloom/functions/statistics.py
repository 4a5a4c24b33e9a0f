"""Exact order statistics by the rules that raster and match reports use, as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Makes the median absolute deviation of a normal law equal its standard deviation.
NMAD_FACTOR = 1.4826


def _sorted(v: Column) -> Column:
    return F.array_sort(F.collect_list(v))


def pick(values: Column, index: Column) -> Column:
    """Element of an array from 0, null outside."""
    return F.get(values, index.cast("int"))


def upper_median(v: Column) -> Column:
    """The upper of the two middle values."""
    s = _sorted(v)
    return pick(s, F.floor(F.size(s) / 2))


def middle_median(v: Column) -> Column:
    """Mean of the two middle values."""
    return F.median(v)


def floor_percentile(v: Column, p: float) -> Column:
    """Element floor(p * n)."""
    s = _sorted(v)
    return pick(s, F.least(F.floor(F.lit(p) * F.size(s)), F.size(s) - 1))


def rounded_percentile(v: Column, p: float) -> Column:
    """Element floor(p * (n - 1) + 0.5)."""
    s = _sorted(v)
    return pick(s, F.floor(F.lit(p) * (F.size(s) - 1) + 0.5))


#: Ranges into which values are cut, so that no task ranks all values of a group: at least and at most.
SPLITS, MOST_SPLITS = 64, 512


def splits(spark) -> int:
    """Ranges for a session: two for each of its shuffle partitions, within the bounds."""
    return min(MOST_SPLITS, max(SPLITS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Hash buckets in which the rows of groups are counted, the rows of a bucket up to which its groups are sorted whole, and
#: the number of larger buckets up to which they are told apart.
BUCKETS, WHOLE_ROWS, MOST_LARGE = 1 << 16, 100_000, 1000


def _range_of(cuts: Column, value: Column, parts: int) -> Column:
    """How many of the sorted cuts, fewer than parts, are below the value: by halving, not by looking at all of them."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range((parts - 1).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < value, step).otherwise(0))


def value_ranks(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, value, c, upto, n: each distinct value of a group, its rows, the rows up to and with it, and the group's rows.

    Values are counted first, then ranked in ranges that an approximate quantile sketch of all distinct values cuts, with the
    ranges' totals as offsets: a task ranks the distinct values of one range of one group. Null values are left out.
    """
    parts = splits(df.sparkSession)
    keys = keys or []
    v = df.filter(F.col(value).isNotNull()).select(*keys, value)
    counts = v.groupBy(*keys, value).agg(F.count("*").alias("c"))
    # one row of parts - 1 numbers; the count is read so that both uses of the counts share an exchange
    cuts = counts.agg(F.percentile_approx(F.when(F.col("c") > 0, F.col(value)), [i / parts for i in range(1, parts)], 20 * parts).alias("_cuts"))
    counts = counts.crossJoin(F.broadcast(cuts)).withColumn("_b", _range_of(F.col("_cuts"), F.col(value), parts)).drop("_cuts")
    totals = counts.groupBy(*keys, "_b").agg(F.sum("c").alias("_sum"))
    whole = Window.partitionBy(*keys)
    totals = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), (F.sum("_sum").over(whole.orderBy("_b")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(whole).alias("n"))
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = F.sum("c").over(Window.partitionBy(*keys, "_b").orderBy(value))
    return counts.withColumn("_inner", inner).join(totals, same).select(*keys, value, "c", (F.col("_inner") + F.col("_before")).alias("upto"), "n")


def picks(df: DataFrame, value: str, ranks: dict[str, Column], keys: list[str] | None = None, number: str | None = None) -> DataFrame:
    """For each group the elements at given places (from 0; columns of n, the number of values) of its sorted values, and n under a name if one is given.

    Hash buckets of groups are counted beforehand: groups of those with WHOLE_ROWS rows at most are sorted as arrays, in one
    exchange by key, the others ranked in ranges. Null values are left out.
    """
    keys = keys or []
    n = [F.col("n").alias(number)] if number else []

    def ranked(rows: DataFrame) -> DataFrame:
        chosen = (F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in ranks.items())
        return value_ranks(rows, value, keys).groupBy(*keys).agg(*chosen, F.max("n").alias("n")).select(*keys, *ranks, *n)

    def whole(rows: DataFrame) -> DataFrame:
        held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_s")).withColumn("n", F.size("_s").cast("long"))
        return held.select(*keys, *(pick(F.col("_s"), place).alias(name) for name, place in ranks.items()), *n)

    if not keys:
        return ranked(df)
    v = df.filter(F.col(value).isNotNull()).select(*keys, value)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    large = [r["_bucket"] for r in v.groupBy(bucket.alias("_bucket")).count().filter(F.col("count") > WHOLE_ROWS).select("_bucket").limit(MOST_LARGE + 1).collect()]
    if not large:
        return whole(v)
    if len(large) > MOST_LARGE:
        return ranked(v)
    return ranked(v.filter(bucket.isin(large))).unionByName(whole(v.filter(~bucket.isin(large))))


def upper_middle() -> Column:
    return F.floor(F.col("n") / 2)


def floor_place(p: float) -> Column:
    """Element floor(p * n), the last one at most."""
    return F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)


def rounded_place(p: float) -> Column:
    """Element round(p * n), the last one at most."""
    return F.least(F.floor(F.lit(p) * F.col("n") + 0.5), F.col("n") - 1)


def medians(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "median") -> DataFrame:
    """Mean of the two middle values of each group, by ranks."""
    found = picks(df, value, {"_a": F.floor((F.col("n") - 1) / 2), "_b": upper_middle()}, keys)
    return found.select(*(keys or []), ((F.col("_a") + F.col("_b")) / 2).alias(name))


def centre_and_nmad(df: DataFrame, value: str) -> DataFrame:
    """One row: median and nmad of all values, by ranks."""
    centre = medians(df, value)
    off = df.crossJoin(F.broadcast(centre)).select("median", F.abs(F.col(value) - F.col("median")).alias("_off"))
    return centre.crossJoin(medians(off, "_off", name="_o")).select("median", (NMAD_FACTOR * F.col("_o")).alias("nmad"))


def nmad(df: DataFrame, keys: list[str], value: str, name: str = "nmad") -> DataFrame:
    """NMAD_FACTOR * median of |value - median| for each group: two passes, the medians joined back in between."""
    centre = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    off = df.join(centre, keys) if keys else df.crossJoin(F.broadcast(centre))
    return off.groupBy(*keys).agg((NMAD_FACTOR * F.median(F.abs(F.col(value) - F.col("_m")))).alias(name))


def shares(df: DataFrame, value: str, wanted: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """For each group the values below which given shares lie, drawn linearly between neighbours, by ranks."""
    place = {name: F.lit(p) * (F.col("n") - 1) for name, p in wanted.items()}
    ends = picks(df, value, {f"{side}{name}": end(at) for name, at in place.items() for side, end in (("_l", F.floor), ("_h", F.ceil))}, keys, "n")
    between = lambda name, at: F.col(f"_l{name}") + (at - F.floor(at)) * (F.col(f"_h{name}") - F.col(f"_l{name}"))
    return ends.select(*(keys or []), *(between(name, at).alias(name) for name, at in place.items()))


def ordered_means(df: DataFrame, value: str, keys: list[str], order: list[str], name: str = "mean") -> DataFrame:
    """keys, name, n: each group's mean of its values, added one after the other in the given order, and its rows.

    A sum of doubles depends on the order of its terms: partial sums would make it that of the tasks. Nulls aren't added.
    """
    rows = Window.partitionBy(*keys).orderBy(*order)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.select(*keys, F.avg(value).over(so_far).alias(name), F.count("*").over(so_far).alias("n"), F.lead(F.lit(1)).over(rows).alias("_more"))
    return run.filter(F.col("_more").isNull()).drop("_more")


def brackets(df: DataFrame, value: str, pct: float, factor: float, keys: list[str] | None = None) -> DataFrame:
    """lo, hi: the interval between the pct and 1 - pct percentiles, widened by factor times its width on both sides."""
    s = shares(df, value, {"_a": 1 - pct, "_b": pct}, keys)
    width = F.col("_b") - F.col("_a")
    return s.select(*(keys or []), (F.col("_a") - factor * width).alias("lo"), (F.col("_b") + factor * width).alias("hi"))


def within_brackets(df: DataFrame, value: str, pct: float, factor: float, keys: list[str] | None = None) -> DataFrame:
    """Rows inside the brackets. Without keys these are one row, which is broadcast."""
    found = brackets(df, value, pct, factor, keys)
    joined = df.join(found, keys) if keys else df.crossJoin(F.broadcast(found))
    return joined.filter((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))).drop("lo", "hi")
