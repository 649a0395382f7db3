"""Secret scans (1), in DataFrame expressions only.

Three fixed patterns give base spans. Beside them, long tokens are scored by two character Markov
models, of random strings and of ordinary identifiers: the log-likelihood ratio of the token's
character pairs, in whole thousandths so that sums are exact. The models are trained from labelled
samples; weak_labels() draws such samples from the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import table, texts

# The base patterns, by kind, with the least length of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(ALPHABET)
# Tokens the models judge, and what they must reach: thousandths of a nat in all and per pair.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_TOTAL = 10_000
LEAST_MEAN = 600
# Documents the samples come from, about; chosen by hash.
SAMPLE_DOCUMENTS = 2_000
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{5,}"
SMOOTHING = 0.5


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def weak_labels(documents: DataFrame, most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """token, random: values of base spans are random strings; other words are identifiers."""
    rows = texts(documents)
    share = 1 << 40
    take = share * most // max(most, rows.count())
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) < take).select("text")
    text = F.col("text")
    secret = F.concat(
        F.filter(found(text, ASSIGN, 2), lambda v: F.length(v) >= LEAST_ASSIGN),
        F.filter(found(text, ACCESS), lambda v: F.length(v) >= LEAST_ACCESS),
        found(text, r"[0-9a-f]{32,}"),
    )
    rest = text
    for pattern in (ASSIGN, ACCESS, r"[0-9a-f]{32,}"):
        rest = F.regexp_replace(rest, pattern, " ")
    both = F.array(
        F.struct(F.lit(True).alias("random"), secret.alias("tokens")),
        F.struct(F.lit(False).alias("random"), found(rest, IDENTIFIER).alias("tokens")),
    )
    return rows.select(F.inline(both)).select("random", F.explode("tokens").alias("token")).distinct()


def train(samples: DataFrame) -> list[int]:
    """Log-likelihood ratio of each character pair, in thousandths, row by row of the alphabet.

    Both models have WIDTH x WIDTH cells, so what comes to the driver is bounded. Without samples of
    a kind its model is uniform; characters outside the alphabet are left out.
    """
    chars = F.filter(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    pairs = samples.select("random", chars.alias("c")).filter(F.size("c") > 1).select(
        "random",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.get("c", i - 1), F.get("c", i)))).alias("pair"),
    )
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}
    out = []
    for a in ALPHABET:
        total = {k: sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (True, False)}
        for b in ALPHABET:
            p = {k: (counts.get((k, a + b), 0) + SMOOTHING) / (total[k] + SMOOTHING * WIDTH) for k in total}
            out.append(round(1000 * math.log(p[True] / p[False])))
    return out


def ratio(token: Column, model: list[int]) -> Column:
    """Summed log-likelihood ratio of a token's pairs."""
    cells = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"))
    step = lambda acc, c: F.struct(
        c.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + F.get(cells, acc["last"] * WIDTH + c)).alias("sum")
    )
    return F.aggregate(codes, start, step, lambda acc: acc["sum"])


def placed(text: Column, matches: Column, kept: Column, kind: int) -> Column:
    """Spans (start, kind, end) of the matches whose flag in `kept` is true.

    Leftmost matches come in order, and a match's text can't occur between the end of the one before
    and its own start (the pattern would have matched there), so searching for it finds its place.
    """
    spans = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    start = F.struct(F.lit(1).alias("at"), spans.alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        here = F.call_function("locate", m["matches"], text, acc["at"])
        end = here + F.length(m["matches"])
        own = F.struct((here - 1).alias("start"), F.lit(kind).alias("kind"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(m["kept"], F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    pairs = F.arrays_zip(matches.alias("matches"), kept.alias("kept"))
    placed_ = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    return F.when(F.exists(kept, lambda k: k), placed_).otherwise(spans)


def scan(documents: DataFrame, model: list[int], whole_rows: bool = False) -> DataFrame:
    """doc_id, text, base and random spans of every row (null text: empty, so none).

    With `whole_rows` also `row`, a struct of all columns the table came with.

    A token the models call random adds a span unless it overlaps a base span. Repeated rows repeat.
    """
    text = F.col("text")
    kept = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if whole_rows else []
    ids = ["doc_id", "text", *["row"] * whole_rows]
    rows = texts(documents, *kept).select(
        *ids, found(text, ASSIGN).alias("m0"), found(text, ASSIGN, 2).alias("v0"),
        found(text, ACCESS).alias("m1"), found(text, r"[0-9a-f]{32,}").alias("m2"), found(text, TOKEN).alias("m3"),
    )
    likely = lambda t: (ratio(t, model) >= LEAST_TOTAL) & (ratio(t, model) >= LEAST_MEAN * (F.length(t) - 1))
    flagged = rows.select(
        *ids, "m0", "m1", "m2", "m3",
        F.transform("v0", lambda v: F.length(v) >= LEAST_ASSIGN).alias("k0"),
        F.transform("m1", lambda v: F.length(v) >= LEAST_ACCESS).alias("k1"),
        F.transform("m2", lambda v: F.length(v) >= LEAST_HEX).alias("k2"),
        F.transform("m3", likely).alias("k3"),
    )
    spans = flagged.select(
        *ids, *[placed(text, F.col(f"m{k}"), F.col(f"k{k}"), k).alias(f"s{k}") for k in range(4)]
    )
    base = spans.withColumn("base", F.array_sort(F.concat("s0", "s1", "s2")))
    apart = F.filter("s3", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return base.withColumn("random", apart)


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def redacted(scanned: DataFrame) -> Column:
    """The text with every span replaced by <kind>; overlapping spans count as one of the first kind."""
    every = F.array_sort(F.concat(scanned["base"], scanned["random"]))
    text = scanned["text"]
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(gap, F.get(names, s["kind"])))).otherwise(acc["parts"]).alias("parts"),
        )

    last = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(every) > 0, F.aggregate(every, start, step, last)).otherwise(text)


def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    got = scan(documents, train(weak_labels(documents)))
    count = lambda k: F.size(F.col(f"s{k}")).cast("long")
    return got.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        digest(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
