"""Language identification (9): a bidirectional gated recurrent network over bytes, in numpy.

Two recurrent passes, one from each end, read the bytes of a window; a softmax over both states labels
every byte position. It is trained by backpropagation through time. A document's probabilities are the
mean over all positions of all its windows. Weights are a few thousand numbers, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.llm.common import batch, rows_of, table

HIDDEN = 8
# Bytes of a window: states do not reach beyond it.
SPAN = 96
WINDOWS = 4096
# Training sample: documents of each language at most (least hashes), characters taken from the middle
# of each; values of lang at most; windows in a step, steps, and the step size.
SAMPLE = 200
SAMPLE_CHARS = 1_500
MOST_LANGUAGES = 1_000
BATCH = 256
STEPS = 220
RATE = 0.02
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """w: per direction what a byte adds to the gates (256 x 3h) and the recurrent weights (h x 3h)."""

    languages: list[str]
    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            w[f"u{d}"] = r.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        w["v"] = r.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        w["c"] = np.zeros(len(languages), np.float32)
        return Network(languages, w)

    def states(self, x: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (positions, windows, h) of one direction over byte windows (windows, positions)."""
        wx, u = self.w[f"x{d}"], self.w[f"u{d}"]
        n, span = x.shape
        h = u.shape[0]
        out = np.empty((span, n, h), np.float32)
        now, steps = np.zeros((n, h), np.float32), []
        for t in range(span) if d == "f" else range(span - 1, -1, -1):
            a, s = wx[x[:, t]], now @ u
            gates = sigmoid(a[:, : 2 * h] + s[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * s[:, 2 * h :])
            after = new + z * (now - new)
            if keep:
                steps.append((t, now, z, r, new, s[:, 2 * h :]))
            out[t] = now = after
        return out, steps

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities (positions, windows, languages)."""
        both = np.concatenate([self.states(x, "f")[0], self.states(x, "b")[0]], axis=2)
        score = both @ self.w["v"] + self.w["c"]
        score -= score.max(axis=2, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=2, keepdims=True)
        return score

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradient back through time."""
        g = {k: np.zeros_like(a) for k, a in self.w.items()}
        kept = {d: self.states(x, d, keep=True) for d in "fb"}
        both = np.concatenate([kept["f"][0], kept["b"][0]], axis=2)
        score = both @ self.w["v"] + self.w["c"]
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        at = np.arange(x.shape[0])
        loss = float(-np.log(p[:, at, y] + 1e-9).mean())
        p[:, at, y] -= 1
        p /= p.shape[0] * p.shape[1]
        g["v"] = np.einsum("tnh,tnk->hk", both, p)
        g["c"] = p.sum((0, 1))
        back = p @ self.w["v"].T
        h = self.w["uf"].shape[0]
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            u = self.w[f"u{d}"]
            flow = np.zeros_like(part[0])
            for t, before, z, r, new, sn in reversed(kept[d][1]):
                flow = flow + part[t]
                dn = flow * (1 - z) * (1 - new**2)
                dz = flow * (before - new) * z * (1 - z)
                dr = dn * sn * r * (1 - r)
                ds = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(g[f"x{d}"], x[:, t], np.concatenate([dz, dr, dn], axis=1))
                g[f"u{d}"] += before.T @ ds
                flow = flow * z + ds @ u.T
        return loss, g


def windows(data: bytes, span: int = SPAN) -> np.ndarray:
    """Byte windows of a text; the last is filled up with blanks."""
    n = max(1, -(-len(data) // span))
    return np.frombuffer(data.ljust(n * span, b" "), np.uint8).reshape(n, span)


def train(texts_: list[str], languages: list[str], steps: int = STEPS, seed: int = 5) -> Network | None:
    """Trains on windows of the given texts; none without texts. Languages are drawn equally often."""
    names = sorted(set(languages))
    if not names:
        return None
    net = Network.fresh(names, seed=seed)
    pools = []
    for name in names:
        own = [windows(t.encode("utf-8", "surrogatepass")) for t, k in zip(texts_, languages, strict=True) if k == name]
        pools.append(np.concatenate(own))
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(a) for k, a in net.w.items()}
    second = {k: np.zeros_like(a) for k, a in net.w.items()}
    for step in range(1, steps + 1):
        y = r.integers(len(names), size=BATCH)
        x = np.stack([pools[k][r.integers(len(pools[k]))] for k in y])
        _, g = net.gradients(x, y)
        norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, a in g.items():
            a = a * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * a
            second[k] = 0.999 * second[k] + 0.001 * a * a
            net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out() -> Column:
    """Whether a document is never learned from; true without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample(documents: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Text middles and languages of at most `most` documents a language, those of least hash.

    Counts give each language a limit that about twice as many hashes pass, so the ranking behind it sees
    few rows, however many tasks read the table. The limits go to the texts, a row a language, so only the
    middles of the passing texts are shuffled. More than MOST_LANGUAGES values of lang raise a ValueError: the
    network has an output for each.
    """
    rows = documents.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)).alias("h"), "text"
    )
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    limits = documents.sparkSession.createDataFrame([(r["lang"], 2.0 * most * (1 << 40) / r["n"]) for r in counts], "lang string, limit double")
    passing = rows.join(F.broadcast(limits), "lang").filter(F.col("h") < F.col("limit"))
    near = passing.select(
        "lang", "h",
        F.expr(f"substring(text, greatest(1, int(length(text) / 2) - {SAMPLE_CHARS // 2}), {SAMPLE_CHARS})").alias("part"),
    ).distinct()
    least = Window.partitionBy("lang").orderBy("h", "part")
    chosen = near.withColumn("k", F.row_number().over(least)).filter(F.col("k") <= most).collect()
    chosen = sorted((r["lang"], r["k"], r["part"]) for r in chosen)
    return [c[2] for c in chosen], [c[0] for c in chosen]


def pooled(net: Network, bodies: list[str]) -> np.ndarray:
    """Mean probabilities of each text over all its byte positions."""
    data = [t.encode("utf-8", "surrogatepass") for t in bodies]
    total = np.zeros((len(data), len(net.languages)))
    waiting: list[tuple[int, np.ndarray, int]] = []
    held = 0

    def flush() -> None:
        x = np.concatenate([w for _, w, _ in waiting])
        p = net.positions(x)
        at = 0
        for doc, w, size in waiting:
            own = p[:, at : at + len(w)]
            sums = own.sum(axis=(0, 1), dtype=np.float64)
            spare = len(w) * SPAN - size
            if spare:
                sums -= own[SPAN - spare :, -1].sum(axis=0, dtype=np.float64)
            total[doc] += sums
            at += len(w)
        waiting.clear()

    for doc, body in enumerate(data):
        every = windows(body)
        for at in range(0, len(every), WINDOWS):
            part = every[at : at + WINDOWS]
            waiting.append((doc, part, min(len(body) - at * SPAN, len(part) * SPAN)))
            held += len(part)
            if held >= WINDOWS:
                flush()
                held = 0
    if waiting:
        flush()
    return total / np.maximum([[len(b)] for b in data], 1)


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(documents: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    und with score 0 where the text is null, empty or has no letter, or where nothing could be learned.
    Repeated rows repeat. The weights travel with the task: their size is fixed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, out, bodies in rows_of(batches, "doc_id", "held_out", "text"):
            for at in range(0, len(ids), 500):
                part = bodies[at : at + 500]
                judged = [k for k, t in enumerate(part) if net and t and any(map(str.isalpha, t))]
                names, scores = [UNKNOWN] * len(part), np.zeros(len(part))
                if judged:
                    p = pooled(net, [part[k] for k in judged])
                    best = p.argmax(1)
                    for k, b, s in zip(judged, best.tolist(), p.max(1).tolist(), strict=True):
                        names[k], scores[k] = net.languages[b], min(1.0, s)
                yield batch({"doc_id": ids[at : at + 500], "held_out": out[at : at + 500], "lang_pred": names, "score": scores}, RESULT)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return identify(documents, train(*sample(documents)))
