"""Quality classifier (operator 7): a factorisation machine.

Inputs of a score: hashed lower-cased words (term frequencies of unit length), statistics of the
text's structure, and its n_chars as metadata. Pairwise interactions have low rank and are summed by the
sum-of-squares identity, 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): linear in the inputs.
It is fitted in numpy on a bounded sample of labelled rows (``most_rows``, documented parameter,
drawn evenly by a hash of the id); scoring covers every row and whole texts, without a shuffle.

Nulls: a null text counts as empty; a null n_chars is replaced by the length of the text. Empty texts
get a score from their structure alone. Rows without usable labels don't take part in fitting; without
any such row of both classes every score is the share of good rows seen (1 if none). Repeated ids in
labels count once, with the largest label. Columns besides doc_id, text and n_chars are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.frames import crc_mod, map_arrow, small_batches, table, text_batches

BUCKETS = 1 << 15
STATS = 14
_buckets: dict[bytes, int] = {}


def words_of(data: bytes) -> np.ndarray:
    """Bucket of every word."""
    out = []
    for w in data.lower().split():
        b = _buckets.get(w)
        if b is None:
            if len(_buckets) > 100_000:
                _buckets.clear()
            b = _buckets[w] = STATS + zlib.crc32(w) % BUCKETS
        out.append(b)
    return np.array(out, np.int64)


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: STATS structure statistics first, then the hashed words."""
    data = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    words = words_of(data)
    n = max(1, len(words))
    index, count = np.unique(words, return_counts=True)
    letters = seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    lines = seen[10] + 1
    stats = np.array([
        1.0,
        np.log1p(len(text) if n_chars is None or n_chars < 0 else n_chars) / 10,
        np.log1p(len(words)) / 10,
        seen[65:91].sum() / max(1, letters),
        letters / size,
        marks / size * 4,
        seen[48:58].sum() / size * 4,
        seen[128:].sum() / size * 4,
        len(index) / n,
        (count.max() if len(count) else 0) / n,
        size / n / 20,
        np.log1p(len(words) / lines) / 6,
        (seen[46] + seen[44]) / n * 2,
        (marks - seen[46] - seen[44]) / n,
    ])
    value = np.sqrt(count)
    if len(value):
        value = value / np.linalg.norm(value)
    return np.concatenate([np.arange(STATS), index]), np.concatenate([stats, value])


@dataclass
class FactorisationMachine:
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def inputs(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        index, x = features(text, n_chars)
        x[:STATS] = (x[:STATS] - self.centre) / self.scale
        return index, x

    def score(self, text: str, n_chars: int | None) -> float:
        index, x = self.inputs(text, n_chars)
        v = self.factors[index] * x[:, None]
        z = self.linear[index] @ x + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 6, rounds: int = 8, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by Adagrad over small batches; the same rows always give the same model."""
    rng = np.random.default_rng(seed)
    size = STATS + BUCKETS
    linear, factors = np.zeros(size), rng.normal(0, 0.03, (size, rank))
    stats = np.array([x[:STATS] for _, x in rows]) if rows else np.zeros((0, STATS))
    centre, scale = (stats.mean(0), stats.std(0) + 1e-6) if rows else (np.zeros(STATS), np.ones(STATS))
    centre[0], scale[0] = 0, 1
    machine = FactorisationMachine(linear, factors, centre, scale)
    share = labels.mean() if len(labels) else 1.0
    if not 0 < share < 1:
        linear[0], factors[:] = 30 if share else -30, 0
        machine.centre[:], machine.scale[:] = 0, 1
        return machine
    rows = [(i, np.concatenate([(x[:STATS] - centre) / scale, x[STATS:]])) for i, x in rows]
    linear[0] = np.log(share / (1 - share))
    seen_l, seen_f = np.full(size, 1e-2), np.full((size, rank), 1e-2)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), 64):
            part = order[low : low + 64]
            index = np.concatenate([rows[k][0] for k in part])
            x = np.concatenate([rows[k][1] for k in part])
            cuts = np.cumsum([0, *(len(rows[k][0]) for k in part)])[:-1]
            v = factors[index] * x[:, None]
            sums = np.add.reduceat(v, cuts, axis=0)
            z = np.add.reduceat(linear[index] * x, cuts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((v * v).sum(1), cuts))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            sizes = np.diff([*cuts, len(index)])
            e = np.repeat(error, sizes)
            slots, place = np.unique(index, return_inverse=True)
            grad = np.zeros(len(slots))
            np.add.at(grad, place, e * x)
            grad += 1e-4 * linear[slots]
            grads = np.zeros((len(slots), rank))
            np.add.at(grads, place, e[:, None] * x[:, None] * (np.repeat(sums, sizes, axis=0) - v))
            grads += 1e-3 * factors[slots]
            seen_l[slots] += grad**2
            seen_f[slots] += grads**2
            linear[slots] -= 0.15 * grad / np.sqrt(seen_l[slots])
            factors[slots] -= 0.03 * grads / np.sqrt(seen_f[slots])
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int) -> tuple[list, np.ndarray]:
    """Inputs and labels of at most about ``most_rows`` labelled rows outside the held-out fold."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(crc_mod("doc_id", 5) != 0)
    share = min(1.0, most_rows / max(1, known.count()))
    if share < 1:
        known = known.where(F.xxhash64("doc_id") < int((2 * share - 1) * 2.0**63))

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        for columns, texts in text_batches(batches):
            made = [features(t, n) for t, n in zip(texts, columns["n_chars"])]
            yield {"quality": columns["quality"], "index": [i.astype("<i4").tobytes() for i, _ in made], "x": [x.astype("<f4").tobytes() for _, x in made]}

    joined = docs.select("doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id")  # at most about most_rows rows
    got = map_arrow(joined, run, "quality int, index binary, x binary").toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in ("index", "x", "quality"))))
    made = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for i, x, _ in rows]
    return made, np.array([q for _, _, q in rows], float)


def score_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    spark = docs.sparkSession
    machine = spark.sparkContext.broadcast(fit(*training_rows(docs, labels, most_rows)))  # fixed size: buckets x (rank + 1)

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        fm = machine.value
        for columns, texts in text_batches(batches):
            yield {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": [fm.score(t, n) for t, n in zip(texts, columns["n_chars"])]}

    folds = docs.select("doc_id", "text", "n_chars", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    scored = map_arrow(folds, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns only."""
    spark = docs.sparkSession
    machine = spark.sparkContext.broadcast(fit(*training_rows(docs, labels, most_rows)))
    names = docs.columns

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        fm = machine.value
        for batch in batches:
            texts, sizes = batch.column(names.index("text")).to_pylist(), batch.column(names.index("n_chars")).to_pylist()
            yield batch.filter(pa.array([fm.score(t or "", n) >= threshold for t, n in zip(texts, sizes)], pa.bool_()))

    small_batches(spark)
    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
