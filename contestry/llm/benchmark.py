"""Benchmark decontamination (6), in DataFrame expressions only.

Numbers, units and names become typed placeholders, so a question with other values has the same
template. Windows of template words are hash-joined with those of the benchmark. Along a diagonal (the
same distance between positions) the matching windows form one occurrence, and its slots must agree:
one benchmark value always stands for the same value of the document. Two benchmark values may become
the same one. Where a whole diagonal disagrees, its runs of consecutive windows are judged by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.llm.common import table, texts

WINDOW = 8
# Windows along one diagonal that make a contamination: 13 words; fewer if the item has no more.
LEAST_WINDOWS = 6
# Template words of a window that are no placeholders, at least.
LEAST_WORDS = 4
# Benchmark windows that are sent to all tasks at most; beyond that Spark joins them by a shuffle.
SENT_WINDOWS = 500_000

NUMBER, UNIT, NAME = "", "", ""
# Unit words that count as such behind a number.
UNITS = (
    "km|m|cm|mm|mi|ft|in|yd|kg|g|mg|lb|oz|l|ml|h|min|s|ms|days?|hours?|minutes?|seconds?|weeks?|months?|years?"
    "|meters?|metres?|kilometers?|miles?|feet|inches|grams?|kilograms?|pounds?|liters?|litres?|dollars?|euros?|cents?|percent"
)


def tokens(text: Column) -> Column:
    """Words in lower case; numbers, units and names with their mark before them.

    A name is a capitalised word inside a sentence, so not one behind a full stop or a line end.
    """
    t = F.regexp_replace(text, "[-]", " ")
    # Only texts with a digit, or a capital inside a sentence, need the passes.
    named = F.regexp_replace(t, r"(?<=[\p{Ll}\p{N},;]\x20)(?=\p{Lu}\p{Ll})", NAME)
    digits = F.regexp_replace(named, r"(?<![\p{L}\p{N}.,])(?=\p{N})", NUMBER)
    units = F.regexp_replace(digits, rf"(?<=\p{{N}}\x20?)(?=(?:{UNITS})(?![\p{{L}}\p{{N}}]))", UNIT)
    marked = F.when(t.rlike(r"\p{N}"), units).otherwise(named)
    return F.regexp_extract_all(F.lower(marked), F.lit("[-]?\\p{L}+|[-]?\\p{N}[\\p{N}.,]*"), F.lit(0))


def windows(rows: DataFrame, *id_: str) -> DataFrame:
    """ids, pos, template (hash of WINDOW template words), slots (their values in order)."""
    marks = F.array(F.lit(NUMBER), F.lit(UNIT), F.lit(NAME))
    slot = lambda t: F.array_contains(marks, F.substring(t, 1, 1))
    listed = rows.select(*id_, tokens(F.col("text")).alias("words"))
    some = F.exists("words", slot)
    shaped = listed.select(
        *id_, "words", some.alias("some"),
        F.when(some, F.transform("words", lambda t: F.when(slot(t), F.substring(t, 1, 1)).otherwise(t))).otherwise(F.col("words")).alias("shape"),
    )
    nothing = F.array().cast("array<string>")

    def one(i: Column) -> Column:
        # get() is a step to one place; slice() would copy the whole array for each window.
        at = lambda name, k: F.get(name, i + k)
        held = F.filter(F.array(*[at("words", k) for k in range(WINDOW)]), slot)
        template = F.xxhash64(*[at("shape", k) for k in range(WINDOW)])
        return F.struct(i.alias("pos"), template.alias("template"), F.when(F.col("some"), held).otherwise(nothing).alias("slots"))

    # Naming shape and some here as well keeps Spark from computing them anew inside the lambda.
    enough = (F.size("shape") >= WINDOW) & F.col("some").isNotNull()
    every = F.when(enough, F.transform(F.sequence(F.lit(0), F.size("shape") - WINDOW), one))
    # The outer form: for the plain one Spark would put a filter, with all of this inlined, before the scan.
    listed = shaped.select(*id_, every.alias("windows")).select(*id_, F.inline_outer("windows"))
    return listed.filter("template is not null")


def contaminated(documents: DataFrame, benchmark: DataFrame, least: int = LEAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_shared, n_slots, same_values of every contamination.

    An item or a document of fewer than WINDOW words has no window and is never reported; neither are
    null texts and null item ids. Rows with one doc_id count as one document. Rows without are judged each by itself and
    reported together.
    """
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = windows(items, "item_id").filter(F.size("slots") <= WINDOW - LEAST_WORDS)
    sizes = known.groupBy("item_id").agg(F.countDistinct("pos").alias("n_windows"))
    asked = known.join(sizes, "item_id").select("item_id", "n_windows", F.col("pos").alias("at"), "template", F.col("slots").alias("values")).distinct()
    if asked.count() <= SENT_WINDOWS:
        asked = F.broadcast(asked)
    # Rows without id are told apart by their text; equal ones have equal slots.
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    met = windows(texts(documents).withColumn("row", own), "doc_id", "row").join(asked, "template").select(
        "doc_id", "row", "item_id", "n_windows", "at", (F.col("pos") - F.col("at")).alias("diagonal"), F.arrays_zip("values", "slots").alias("pairs")
    )
    occurrence = ["doc_id", "row", "item_id", "n_windows", "diagonal"]
    run = F.col("at") - F.dense_rank().over(Window.partitionBy(*occurrence).orderBy("at"))
    distinct = lambda lists: F.array_distinct(F.flatten(lists))
    runs = met.withColumn("run", run).groupBy(*occurrence, "run").agg(F.countDistinct("at").alias("n_shared"), distinct(F.collect_set("pairs")).alias("pairs"))
    shared = runs.groupBy(*occurrence).agg(
        F.sum("n_shared").alias("n_shared"), distinct(F.collect_list("pairs")).alias("pairs"), F.collect_list(F.struct("n_shared", "pairs")).alias("runs")
    )
    need = F.least(F.lit(least), F.col("n_windows"))
    agreed = lambda n, pairs: (n >= need) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["values"]))) == F.size(pairs))
    whole = F.array(F.struct("n_shared", "pairs"))
    found = F.when(agreed(F.col("n_shared"), F.col("pairs")), whole).otherwise(F.filter("runs", lambda r: agreed(r["n_shared"], r["pairs"])))
    return (
        shared.select("doc_id", "item_id", "n_windows", F.inline(found))
        .select("doc_id", "item_id", "n_windows", "n_shared", F.size("pairs").alias("n_slots"), F.forall("pairs", lambda p: p["values"] == p["slots"]).alias("same_values"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("n_windows").cast("long").alias("n_windows"), F.max("n_shared").cast("long").alias("n_shared"),
            F.max("n_slots").cast("long").alias("n_slots"), F.max("same_values").alias("same_values"),
        )
    )


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
