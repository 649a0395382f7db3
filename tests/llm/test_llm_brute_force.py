"""Columns of the queries that a contract fixes, against plain Python over whole test tables."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from contestry.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
# The smallest table holds no secret.
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not (os.path.isdir(FOLDER) and os.path.isdir(LARGER)), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run(spark, start, folder=FOLDER):
    (name,) = [n for n in QUERIES if n.startswith(start)]
    return QUERIES[name](spark, folder).collect()


def documents(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_op1_base_spans(spark):
    assign = re.compile(
        r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII
    )
    kinds = [("assign", assign, 1, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]
    want = []
    for doc_id, text in documents(spark, LARGER):
        spans = [
            (m.start(), k, m.end())
            for k, (_, pattern, group, least) in enumerate(kinds)
            for m in pattern.finditer(text or "")
            if len(m.group(group)) >= least
        ]
        digest = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
        want.append((doc_id, *[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(digest.encode()).hexdigest()))
    got = run(spark, "op1_", LARGER)
    assert counted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == counted(want)
    assert sum(w[1] + w[2] + w[3] for w in want) > 0
    # The method adds spans and keeps the base ones.
    for r in got:
        base = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_op3_counts(spark):
    want = []
    for doc_id, text in documents(spark):
        text = text or ""
        words = WORD.findall(text)
        seen, repeated = set(), 0
        for line in text.split("\n"):
            repeated += bool(WORD.search(line)) and line in seen
            seen.add(line)
        triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(triples)
        covered = {k + j for k, t in enumerate(triples) if often[t] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed))
    got = run(spark, "op3_")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert counted(tuple(r[n] for n in names) for r in got) == counted(want)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_op5_fingerprints_and_components(spark):
    rows = documents(spark)
    fps = []
    for _, text in rows:
        words = [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in WORD.findall(text or "")]
        k = min(4, len(words))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    bits = np.array(fps, np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    while True:
        wider = near @ near
        if (wider == near).all():
            break
        near = wider
    ids = np.array([r[0] for r in rows])
    want = {(int(ids[k]), f"{fps[k]:016x}", int(ids[near[k]].min())) for k in range(len(rows))}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op5_")} == want


def test_op7_hosts_and_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    got = run(spark, "op7_")
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()}
    assert len(got) == len(urls)
    for r in got:
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
