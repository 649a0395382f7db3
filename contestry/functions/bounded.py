"""Building blocks that keep every task's input bounded, whatever the key skew.

A window over a business key (a team, a pairing) is one task's work per key. That is the
cheapest plan while keys are small, and the wrong one when a key holds a large share of all
rows. The helpers here measure the largest key once and, past a limit, replace the window by
a two-level scan: local work per (key, day), a running total over days (one row per key and
calendar day), and fixed-size position buckets that carry the few rows a frame looks back on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows a single window group may hold before the two-level scan takes over.
GROUP_LIMIT = 5_000_000
# Positions per bucket in the two-level scan.
BUCKET_ROWS = 1_000_000
# Bins a distribution is cut into when an exact quantile is looked up.
QUANTILE_BINS = 256


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the fullest key (one map-side combined aggregate)."""
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def needs_split(df: DataFrame, keys: list[str], mode: str, limit: int) -> bool:
    if mode == "auto":
        return largest_group(df, keys) > limit
    if mode not in ("plain", "split"):
        raise ValueError(f"unknown mode {mode!r}")
    return mode == "split"


def running_before(df: DataFrame, keys: list[str], day: str, sums: dict[str, str]) -> DataFrame:
    """Per (key, day): totals of the earlier days. `sums` maps output name to a column.

    The grouped input has one row per key and calendar day, so the window group is bounded by
    the calendar and not by the number of facts.
    """
    daily = df.groupBy(*keys, day).agg(
        *[F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(o) for o, c in sums.items()]
    )
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(
        *keys, day, *[F.coalesce(F.sum(o).over(w), F.lit(0)).alias(o) for o in sums]
    )


def dense_position(
    df: DataFrame, keys: list[str], day: str, tie: str, counted: dict[str, str]
) -> DataFrame:
    """Adds, per entry of `counted` (output: 0/1 column), how many counted rows of the key
    come strictly before the row in (day, tie) order."""
    names = list(counted)
    local = Window.partitionBy(*keys, day).orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = df
    for out, flag in counted.items():
        rows = rows.withColumn(
            f"__in_{out}",
            F.coalesce(F.sum(F.col(flag).cast("long")).over(local), F.lit(0)),
        )
    before = running_before(df, keys, day, {f"__pre_{o}": c for o, c in counted.items()})
    joined = rows.join(before, [*keys, day], "left")
    for out in names:
        joined = joined.withColumn(out, F.col(f"__in_{out}") + F.col(f"__pre_{out}"))
    return joined.drop(*[f"__in_{o}" for o in names], *[f"__pre_{o}" for o in names])


def with_halo(df: DataFrame, position: str, reach: int, bucket_rows: int) -> DataFrame:
    """Copies each row into its position bucket and, if later rows look back on it, the next.

    `position` is zero-based and dense. Adds `__bucket` and `__own` (false for look-back copies).
    """
    if bucket_rows < reach:
        raise ValueError("a bucket must hold at least the look-back reach")
    home = F.floor(F.col(position) / bucket_rows).cast("long")
    nxt = F.floor((F.col(position) + reach) / bucket_rows).cast("long")
    return df.withColumn("__home", home).withColumn(
        "__bucket", F.explode(F.array_distinct(F.array(home, nxt)))
    ).withColumn("__own", F.col("__bucket") == F.col("__home")).drop("__home")


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes a result that several later jobs read, and returns the written table.

    Survives the loss of executors, unlike cached blocks, and cuts the lineage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, as columns q0, q1, ...

    Values are counted per distinct value, and approximate marks cut them into bins of about
    equal size. Exact counts per bin tell which bins hold the wanted ranks; only the values of
    those bins are put in order. `weight` names a column of repeat counts.
    """
    if not keys:
        all_rows = df.withColumn("__all", F.lit(0))
        return exact_quantiles(all_rows, ["__all"], value, probs, weight).drop("__all")
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(times).alias("n"))
    )
    cuts = [i / QUANTILE_BINS for i in range(1, QUANTILE_BINS)]
    marks = counts.groupBy(*keys).agg(
        F.percentile_approx(value, cuts, 10_000).alias("marks"), F.sum("n").alias("total")
    )
    binned = counts.join(marks, keys).withColumn(
        "bin", F.size(F.filter("marks", lambda m: m < F.col(value)))
    ).drop("marks")
    upto = Window.partitionBy(*keys).orderBy("bin")
    bins = (
        binned.groupBy(*keys, "bin", "total").agg(F.sum("n").alias("bn"))
        .withColumn("last", F.sum("bn").over(upto) - 1)
        .withColumn("first", F.col("last") - F.col("bn") + 1)
    )
    slots = F.array(
        *[F.struct(F.lit(i).alias("slot"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]
    )
    rank = (F.col("total") - 1) * F.col("p")
    wanted = (
        bins.select(*keys, "bin", "total", "first", "last", F.inline(slots))
        .withColumns({"lo": F.floor(rank), "hi": F.ceil(rank), "frac": rank - F.floor(rank)})
        .filter(F.col("lo").between(F.col("first"), F.col("last")) | F.col("hi").between(F.col("first"), F.col("last")))
        .select(*keys, "bin", "first", "slot", "lo", "hi", "frac")
    )
    within = Window.partitionBy(*keys, "slot", "bin").orderBy(value)
    ordered = (
        binned.join(wanted, [*keys, "bin"])
        .withColumn("end", F.col("first") + F.sum("n").over(within) - 1)
        .withColumn("begin", F.col("end") - F.col("n") + 1)
    )

    def at(r: str):
        return F.max(F.when(F.col(r).between(F.col("begin"), F.col("end")), F.col(value)))

    picked = ordered.groupBy(*keys, "slot").agg(at("lo").alias("a"), at("hi").alias("b"), F.max("frac").alias("f"))
    q = picked.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
    return q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("slot") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))]
    )
