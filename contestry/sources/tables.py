"""Keyed tables on Parquet: upserts, payload snapshots, logs and the model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Keyed upsert in which a new NULL never erases an old value.

    Old and new rows go through one grouped aggregate, which combines before the shuffle, so a
    key repeated many times in the new rows does not pile up in one task. Among new rows of one
    key the last in `order` with a value wins, column by column.
    """
    values = [c for c in old.columns if c not in keys]
    version = F.struct(F.lit(1).alias("new"), (F.col(order) if order else F.lit(0)).alias("seq"))
    seq_type = new.schema[order].dataType if order else "int"
    tagged_new = new.select(*keys, *values, version.alias("__v"))
    tagged_old = old.select(
        *keys, *values, F.struct(F.lit(0).alias("new"), F.lit(None).cast(seq_type).alias("seq")).alias("__v")
    )
    return tagged_old.unionByName(tagged_new).groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__v"))).alias(c) for c in values]
    )


def payload_rows(features: DataFrame, columns: list[str], version: str) -> DataFrame:
    """Versioned JSON payload per contest; missing values are written as null."""
    clean = [
        F.nanvl(F.col(c), F.lit(None)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in features.dtypes
        if c in columns
    ]
    return features.select(
        "match_id",
        F.lit(version).alias("version"),
        "as_of_date",
        F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("payload"),
    )


def read_payload(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select("match_id", "version", F.from_json("payload", schema).alias("f")).select(
        "match_id", "version", "f.*"
    )


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def season_status(contests: DataFrame) -> DataFrame:
    return contests.groupBy("league_id", "season").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


# --- model registry ----------------------------------------------------------------------------


def _promoted():
    return F.coalesce(F.get_json_object("metrics_json", "$.promoted").cast("boolean"), F.lit(True))


def latest_promoted(registry: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest promoted version; a version without the flag counts as promoted."""
    live = registry.filter(_promoted())
    best = F.max_by(
        F.struct("model_version", "trained_at", "metrics_json"), F.struct("trained_at", "model_version")
    ).alias("b")
    grouped = live.groupBy(*keys).agg(best) if keys else live.agg(best).filter(F.col("b").isNotNull())
    return grouped.select(*(keys or []), "b.*")


def registry_table(registry: DataFrame) -> DataFrame:
    loss = F.get_json_object("metrics_json", "$.reference_logloss").cast("double")
    return registry.select(
        "model_version",
        "trained_at",
        "train_window",
        F.coalesce(F.get_json_object("metrics_json", "$.val_season"), F.lit("-")).alias("val_season"),
        F.round(loss, 4).alias("reference_logloss"),
        _promoted().alias("promoted"),
    )


def promotion_gate(candidates: DataFrame, registry: DataFrame, max_regression: float) -> DataFrame:
    """Candidate versions with the decision whether they may replace the newest promoted one.

    A candidate whose loss exceeds the previous loss by more than the allowed share is
    recorded but not promoted.
    """
    previous = latest_promoted(registry).select(
        F.col("model_version").alias("previous_version"),
        F.get_json_object("metrics_json", "$.reference_logloss").cast("double").alias("previous_loss"),
    )
    single = candidates.withColumn("__one", F.lit(1)).join(
        previous.withColumn("__one", F.lit(1)), "__one", "left"
    ).drop("__one")
    limit = F.col("previous_loss") * (1.0 + max_regression)
    return single.withColumn(
        "promoted", F.col("previous_loss").isNull() | (F.col("val_loss") <= limit)
    )
