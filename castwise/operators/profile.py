"""Profiling: nulls, describe, correlation, skewness, histogram, density,
value counts and top-n listings (C8-C10, A12-A17, T1, T2).

Every statistic over many columns is one aggregate pass that produces one
wide row, then unpivoted to a long ``(column, ...)`` table.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import r6

# The review score columns and the numeric item columns profiled.
REVIEW_NUMERIC = ("story_score", "acting_cast_score", "music_score", "rewatch_value_score",
                  "overall_score", "n_helpful")
ITEM_NUMERIC = ("year", "tot_eps", "duration", "rank", "pop", "start_month",
                "start_day_of_week", "duration_days")


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column_name, n_null)`` for each column."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "n_null")


def info(df: DataFrame) -> DataFrame:
    """``(column_name, dtype, non_null)``."""
    types = dict(df.dtypes)
    wide = df.agg(*[F.count(c).alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "column_name", "non_null")
    m = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
    return long.select("column_name", m[F.col("column_name")].alias("dtype"), "non_null")


def _long(df: DataFrame, cols) -> DataFrame:
    return (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], list(cols), "column_name", "v").where(F.col("v").isNotNull()))


def exact_quantiles(df: DataFrame, cols, probs) -> DataFrame:
    """(column_name, p, value): exact quantiles, linear between neighbours.

    Values are counted, the distinct ones range-partitioned, and a value's
    ranks follow from the counts before its partition and before it within
    the partition. No task holds a whole column's values.
    """
    from ..session import materialize
    counts = _long(df, cols).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.repartitionByRange("column_name", "v").withColumn("part", F.spark_partition_id()), "value_counts")
    per = counts.groupBy("column_name", "part").agg(F.sum("n").alias("m"))  # a row a partition and column
    per = per.select("column_name", "part", F.expr("sum(m) over (partition by column_name order by part) - m").alias("before"),
                     F.expr("sum(m) over (partition by column_name)").alias("total"))
    r = counts.join(per, ["column_name", "part"]).withColumn("hi", F.expr("sum(n) over (partition by column_name, part order by v)") + F.col("before"))
    r = (r.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("pos", F.col("p") * (F.col("total") - 1))
         .withColumn("lo", F.col("hi") - F.col("n")))
    at = lambda k: F.max(F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col("v")))
    g = r.groupBy("column_name", "p", "pos").agg(at(F.floor("pos")).alias("a"), at(F.ceil("pos")).alias("b"))
    return g.select("column_name", "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).alias("value"))


def modes(df: DataFrame, cols) -> DataFrame:
    """(column_name, value): the most frequent non-null text of each column, the smallest on ties."""
    counts = (df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "v")
              .where(F.col("v").isNotNull()).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))).alias("m")).select("column_name", F.col("m.v").alias("value"))


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, sample std, min, exact linear quartiles, max."""
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    v = F.col("v")
    s = _long(df, cols).groupBy("column_name").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                                   F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(df, cols, (0.25, 0.5, 0.75)).groupBy("column_name").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
    q = q.toDF("column_name", "p25", "p50", "p75")
    return every.join(s, "column_name", "left").join(q, "column_name", "left").select(
        "column_name", F.coalesce("count", F.lit(0).cast("long")).alias("count"), *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pairwise-complete Pearson correlation, long ``(col_a, col_b, corr)``.

    ``corr`` throws on a constant column under ANSI mode, so it is written as
    covar_pop / (stddev_pop x stddev_pop) over the rows where both are
    present, with a guarded division: a constant column gives null.
    """
    # the guarded formula is symmetric: compute i <= j once, emit both orders
    cols = list(cols)
    aggs, pairs = [], [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        sx = F.stddev_pop(F.when(both, x))
        sy = F.stddev_pop(F.when(both, y))
        aggs.append(F.try_divide(F.covar_pop(x, y), sx * sy).alias(f"c{i}"))
    wide = df.agg(*aggs)
    idx = {p: i for i, p in enumerate(pairs)}
    rows = []
    for a, b in product(cols, cols):
        i = idx.get((a, b), idx.get((b, a)))
        rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                             r6(F.when(F.col(f"c{i}") > 1.0, 1.0).when(F.col(f"c{i}") < -1.0, -1.0)
                                .otherwise(F.col(f"c{i}"))).alias("corr")))
    return wide.select(F.inline(F.array(*rows)))


def skewness(df: DataFrame, cols) -> DataFrame:
    """Bias-adjusted sample skewness (the pandas definition).

    G1 = g1 * sqrt(n (n - 1)) / (n - 2) with g1 the population skewness;
    a constant column with n >= 3 gives 0, n < 3 gives null.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.skewness(x).alias(f"{c}__g"),
                 F.stddev_pop(x).alias(f"{c}__s")]
    wide = df.agg(*aggs)
    rows = []
    for c in cols:
        n = F.col(f"{c}__n").cast("double")
        adj = F.try_divide(F.col(f"{c}__g") * F.sqrt(n * (n - 1)), n - 2)
        val = (F.when(n < 3, F.lit(None)).when(F.col(f"{c}__s") == 0, F.lit(0.0)).otherwise(adj))
        rows.append(F.struct(F.lit(c).alias("column_name"), r6(val).alias("skewness")))
    return wide.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, cols, bins: int = 10) -> DataFrame:
    """Equal-width bins between each column's min and max.

    ``(column_name, bin, bin_lo, bin_hi, n)`` with a row for every bin, empty
    ones too; the last bin is closed on the right, a constant column puts
    everything in bin 0. One scan: columns are unpivoted to ``(column_name,
    v)``; per-column bounds are a tiny table (one row per column) joined back
    by broadcast.
    """
    long = _long(df, cols)
    bounds = long.groupBy("column_name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = long.join(F.broadcast(bounds), "column_name")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = v.groupBy("column_name", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = bounds.select("column_name", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (every.join(counts, ["column_name", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
            .select("column_name", "bin",
                    r6(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_lo"),
                    r6(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_hi"),
                    "n"))


def density(df: DataFrame, cols, points: int = 50) -> DataFrame:
    """Gaussian kernel density of each column on an even grid, Scott bandwidth.

    h = std * n^(-1/5). Values are first reduced to (column, value, count);
    each distinct value then adds its kernel to every grid point through an
    array expression and one grouped sum -- the grid is a fixed-size array, so
    the work is points x distinct values. A constant column has no density.
    """
    vals = _long(df, cols)
    stats = vals.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                                            F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("sd") > 0)
    counts = (vals.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("cnt"))
              .join(F.broadcast(stats), "column_name"))  # one row a column
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)),
                       lambda i: F.struct(i.alias("point"),
                                          (F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x")))
    e = counts.select("column_name", "cnt", "v", "n", h.alias("h"), F.explode(grid).alias("g"))
    contrib = F.col("cnt") * F.exp(-F.pow((F.col("g.x") - F.col("v")) / F.col("h"), 2) / 2)
    return (e.groupBy("column_name", F.col("g.point").alias("point"), F.col("g.x").alias("x"))
            .agg((F.sum(contrib) / (F.first("n") * F.first("h") * F.sqrt(F.lit(2 * 3.141592653589793))))
                 .alias("density"))
            .select("column_name", "point", r6("x").alias("x"), r6("density").alias("density")))


def binned_density(df: DataFrame, cols, points: int = 50, error: float = 1e-8, reach: float = 8.0) -> DataFrame:
    """A17 for continuous columns: (column_name, point, x, kernel_mean, density).

    As ``density``, but values are first dealt linearly to the two nearest
    points of a fine grid, so the work after one grouped sum is that grid's
    size however many values differ. The grid's step is sqrt(8 error)
    bandwidths: linear dealing changes a Gaussian kernel by at most step^2 / 8
    of its height, so ``kernel_mean`` (the mean kernel height, density =
    kernel_mean / (h sqrt(2 pi))) is within ``error`` + exp(-reach^2 / 2) of the
    exact sum, kernels being cut ``reach`` bandwidths out.
    """
    vals = _long(df, cols)
    stats = vals.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("sd") > 0)
    stats = F.broadcast(stats.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))))  # one row a column
    step = F.col("h") * (8 * error) ** 0.5
    at = vals.join(stats, "column_name").withColumn("p", (F.col("v") - F.col("lo")) / step).withColumn("i", F.floor("p"))
    bins = at.groupBy("column_name", "i").agg(F.sum(1 - (F.col("p") - F.col("i"))).alias("w0"), F.sum(F.col("p") - F.col("i")).alias("w1"))
    b = bins.join(stats, "column_name").withColumns({"b0": F.col("lo") + F.col("i") * step, "b1": F.col("lo") + (F.col("i") + 1) * step})
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("point"), (F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x")))
    height = lambda x, c: F.exp(-F.pow((x - F.col(c)) / F.col("h"), 2) / 2)
    near = F.filter(grid, lambda g: F.abs(g["x"] - F.col("b0")) <= F.col("h") * (reach + 1))
    e = b.select("column_name", "w0", "w1", "b0", "b1", "h", F.explode(near).alias("g"))
    sums = e.groupBy("column_name", F.col("g.point").alias("point")).agg(F.sum(F.col("w0") * height(F.col("g.x"), "b0") + F.col("w1") * height(F.col("g.x"), "b1")).alias("s"))
    every = stats.select("column_name", "n", "h", F.explode(grid).alias("g")).select("column_name", "n", "h", F.col("g.point").alias("point"), F.col("g.x").alias("x"))
    mean = F.coalesce("s", F.lit(0.0)) / F.col("n")
    return (every.join(sums, ["column_name", "point"], "left")
            .select("column_name", "point", "x", mean.alias("kernel_mean"), (mean / (F.col("h") * (2 * 3.141592653589793) ** 0.5)).alias("density")))


SKETCH_LOG_K = 12
#: Three standard errors of a sketch with 2 ** SKETCH_LOG_K registers.
SKETCH_BOUND = 3 * 1.04 / 2 ** (SKETCH_LOG_K / 2)


def distinct_sketches(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """A5, approximate: (keys, sketch) of the distinct values of ``col``; sketches merge to coarser keys."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(col, F.lit(SKETCH_LOG_K)).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, estimate): distinct values per coarser group, from the sketches alone; right to ``SKETCH_BOUND`` in all but rare cases."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def value_counts(df: DataFrame, col: str, top_n: int | None = None) -> DataFrame:
    """``(value, n)`` by count desc then value; nulls excluded."""
    out = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
           .agg(F.count(F.lit(1)).alias("n")))
    if top_n is not None:
        out = out.orderBy(F.col("n").desc(), "value").limit(top_n)
    return out


def top_n_by(df: DataFrame, col: str, key: str, top_n: int = 10, cols=()) -> DataFrame:
    """The ``top_n`` rows with the largest ``col`` (nulls out), ties by key."""
    return (df.where(F.col(col).isNotNull()).orderBy(F.col(col).desc(), key)
            .limit(top_n).select(key, *cols, col))


def preview(df: DataFrame, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """C11: deterministic random rows: order by md5(seed|key)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)
