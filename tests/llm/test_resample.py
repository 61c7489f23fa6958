import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.llm.resample import BUCKETS, chunks, features, in_order, resample

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    words = WORDS.findall((text or "").encode().lower())
    return [zlib.crc32(b" ".join(words[k : k + n])) % BUCKETS for n in (1, 2, 3) for k in range(len(words) - n + 1)], len(words)


def brute(docs, targets):
    found = [(i, *buckets(t)) for i, t in docs]
    s, t = np.zeros(BUCKETS, int), np.zeros(BUCKETS, int)
    for _, b, _ in found:
        np.add.at(s, np.array(b, int), 1)
    for x in targets:
        np.add.at(t, np.array(buckets(x)[0], int), 1)
    big, small = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[k]) + 1) * (big + BUCKETS) / ((int(s[k]) + 1) * (small + BUCKETS)))) for k in range(BUCKETS)]
    rows = []
    for i, b, n in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        rows.append([i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(long[: 5 * len(long) // 100])}
    return sorted([(*r, rank.get(id(r))) for r in rows], key=str)


def got(frame):
    return sorted([tuple(r) for r in frame.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()], key=str)


@pytest.mark.parametrize("words, per_part", [(4096, 500_000), (7, 11)])
def test_against_brute_force(spark, words, per_part):
    docs, target = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got(resample(docs, target, words=words, rows_per_part=per_part)) == want and sum(r[5] is not None for r in want) > 3


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    long = " ".join("w" * int(n) + str(k % 9) for k, n in enumerate(rng.integers(0, 9, 30_000))) + " " + "Z" * 9000 + " é" + "\0ü. " * 30 + "q" * 64 + " " + "r" * 65
    rows = [(k, " ".join(f"W{(k * j) % 17}" for j in range(k % 40))) for k in range(60)] + [(7, "twice " * 30)] * 4 + [(None, "no id " * 30), (1, None), (2, ""), (3, " ., "), (4, long), (5, long), (6, "Ab Cd éÉ")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, key int, row string")
    target = spark.createDataFrame([("W1 W2 W3 twice",), (None,), ("",)], "text string")
    for words in (5, 4096):
        assert got(resample(docs, target, words=words)) == brute(rows, ["W1 W2 W3 twice"])
    none = docs.limit(0)
    assert resample(none, target).count() == 0 and resample(docs, target.limit(0)).where("rank is not null").count() == 1
    assert chunks(docs, "doc_id", 100).where("key = 4").count() == 302  # the short text of id 4 is one


def test_chunks_own_their_starts():
    """Features of chunks with their carried words are those of the whole, each once."""
    text = " ".join(f"t{k}" for k in range(23))
    words = text.split()
    whole = np.sort(features([text], [None])[0])
    pieces = [" ".join(words[k : k + 5 + 2]) for k in range(0, 23, 5)]
    bucket, owner, own = features(pieces, [5] * 5)
    assert np.array_equal(np.sort(bucket), whole) and own.tolist() == [5, 5, 5, 5, 3] and len(owner) == len(bucket) == 3 * 23 - 3
    assert sorted(buckets(text)[0]) == whole.tolist()


def test_in_order(spark):
    df = spark.range(1000).selectExpr("id % 7 as a", "id as b")
    out = in_order(df, F.col("a").desc(), F.col("b"), rows_per_part=90).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 1001)) and [(r.a, r.b) for r in out] == sorted(((k % 7, k) for k in range(1000)), key=lambda x: (-x[0], x[1]))
