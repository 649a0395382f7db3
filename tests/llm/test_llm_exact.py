"""Cuckoo-filter index against a dictionary, verdicts against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from contestry.llm import exact

SCHEMA = "doc_id long, text string, digest string, n string, keep string"
ROWS = [
    (1, "Hello World"), (2, "hello world"), (3, "HELLO WORLD"), (3, "HELLO WORLD"), (4, "É"), (5, "é"), (6, None), (7, ""),
    (None, "hello world"), (None, "alone"), (None, "alone"), (8, "x" * 300_000), (9, "X" * 300_000), (-5, "alone "),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def plain(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def verdicts(index):
    rows = index.verdicts().collect()
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in rows), key=str)


def test_filter_against_dictionary_with_overflow():
    r = random.Random(1)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    # keys that share fingerprint and bucket with others are told apart by the stored key
    keys += [k[:10] + bytes(22 - len(str(n))) + str(n).encode() for n, k in enumerate(keys[:500])]
    filter_, want = exact.Cuckoo(1), {}
    for _ in range(20_000):
        key = r.choice(keys)
        if key in want and r.random() < 0.4:
            filter_.delete(key, want.pop(key), None)
        else:
            filter_.insert(key, 1, 5)
            want[key] = want.get(key, 0) + 1
    assert filter_.buckets > 1
    for own in (filter_, exact.Cuckoo.read(filter_.row(0))):
        assert {k: own.counts[p] for k in keys if (p := own.place(k)) >= 0} == want
    with pytest.raises(ValueError):
        filter_.delete(next(k for k in keys if k not in want), 1, None)


@pytest.mark.parametrize("shard_keys", [2, exact.SHARD_KEYS])
def test_verdicts_against_brute_force(spark, shard_keys):
    assert verdicts(exact.build(frame(spark, ROWS), shard_keys)) == brute(ROWS)


def test_insertion_and_deletion(spark):
    index = exact.insert(exact.build(frame(spark, ROWS[:4]), 2), frame(spark, ROWS[4:]), 2)
    assert index.count > 2 and verdicts(index) == brute(ROWS)
    gone = [ROWS[2], ROWS[3], (None, "alone"), (8, "x" * 300_000), (7, "")]
    left = list(ROWS)
    for row in gone:
        left.remove(row)
    assert verdicts(exact.delete(index, frame(spark, gone))) == brute(left)
    with pytest.raises(Exception, match="not in the index"):
        exact.delete(index, frame(spark, [(77, "never seen")]))


def test_empty_table(spark):
    index = exact.build(frame(spark, []))
    assert verdicts(index) == [] and verdicts(exact.insert(index, frame(spark, ROWS))) == brute(ROWS)
