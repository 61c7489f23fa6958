"""Approximate nearest neighbours (operator 4): inverted file with product-quantised residuals.

Equal vectors are one class with its six smallest ids, which is all that five neighbours can need. A coarse k-means
and the residuals' codebooks are fitted on a bounded sample (``sample``, documented parameter); every
class is indexed. Queries probe the nearest lists; a list's codes are compared through asymmetric
distance tables, the shortlist is reranked by the exact cosine of the original vectors. An audit compares some hundred of the very
queries with every class by brute force and chooses how many lists to probe and how long the shortlist is: queries may lie
where few others do, and a dense group may share one code, so neither follows from the sample. Long lists are cut into
blocks and the queries of a list into chunks of its own, so that every group is of bounded size and a list is copied only as
often as its own queries ask for.

Null, zero or non-finite vectors, vectors of a rarer length and null ids take no part. Ties go to the smaller
id. A repeated id counts once for equal vectors. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastrum.llm.frames import map_arrow, skew_join, table, written
from rastrum.llm.vectors import cosines, matrix, part_rule, unit

NEAR = 5
#: Most components of all vectors that the index is fitted on (on the driver).
SAMPLE_NUMBERS = 4_000_000
BLOCK = 4096


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, some rows at a time."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[low : low + BLOCK] @ centres.T - half, 1) for low in range(0, len(x), BLOCK)] or [np.zeros(0, int)])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = closest(x, centres)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        full = counts > 0
        centres = centres.copy()
        centres[full] = sums[full] / counts[full, None]
    return centres


@dataclass
class Index:
    """Coarse centroids, and a codebook of up to 256 words for each part of the residual."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]
    probes: int = 1
    shortlist: int = 256

    @staticmethod
    def fit(x: np.ndarray, lists: int, seed: int = 11) -> Index:
        rng = np.random.default_rng(seed)
        x = unit(x.astype(np.float64))
        x = x[rng.permutation(len(x))]
        centroids = k_means(x, min(lists, len(x)), 10, rng)
        rest = x - centroids[closest(x, centroids)]
        parts = np.array_split(np.arange(x.shape[1]), max(1, min(16, x.shape[1] // 4)))
        return Index(centroids, [k_means(rest[:, p], min(256, len(x)), 6, rng) for p in parts])

    def parts(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.centroids.shape[1]), len(self.codebooks))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = closest(x, self.centroids)
        rest = x - self.centroids[home]
        codes = [np.argmax(rest[:, p] @ c.T - (c**2).sum(1) / 2, 1) for p, c in zip(self.parts(), self.codebooks)]
        return home, np.stack(codes, 1).astype(np.uint8)

    def approximate(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with coded vectors of one list, from one table of each query's parts."""
        total = np.repeat((q @ self.centroids[home])[:, None], len(codes), 1)
        for k, (p, c) in enumerate(zip(self.parts(), self.codebooks)):
            total += (q[:, p] @ c.T)[:, codes[:, k]]
        return total


def audit(index: Index, coded: DataFrame, asking: DataFrame, counts: np.ndarray, aim: float = 0.985, queries: int = 256) -> None:
    """Sets the least number of probed lists with which ``aim`` of the true neighbours of some queries lie in them, and a fifth
    more; and the shortlist (256 at least) in which their lists' coded order keeps as many. Rows with the code of a neighbour count
    as before it.

    ``coded`` are all classes with their list and codes, ``asking`` those (cid, embedding) that are asked for.
    """
    picked = asking.orderBy(F.xxhash64("cid"), "cid").limit(queries).toArrow()  # a fixed number of rows
    if not picked.num_rows:
        return
    cids, q = picked.column("cid").to_numpy(), unit(matrix(picked.column("embedding")))
    spark = coded.sparkSession
    asked = spark.sparkContext.broadcast((cids, q))

    def nearest_of(batches: Iterable) -> Iterator[dict[str, list]]:
        cids, q = asked.value
        held = (np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            s = q @ unit(matrix(batch.column(1))).T
            s[cids[:, None] == own] = -2
            new = (s, np.broadcast_to(own, s.shape), np.broadcast_to(batch.column(2).to_numpy(), s.shape))
            held = tuple(np.concatenate(both, 1) for both in zip(held, new))
            best = np.argsort(-held[0], 1, kind="stable")[:, :NEAR]
            held = tuple(np.take_along_axis(h, best, 1) for h in held)
        at, k = np.nonzero(held[0] > -2)
        yield {"q": at, "score": held[0][at, k], "cid": held[1][at, k], "list": held[2][at, k]}

    found = map_arrow(coded.select("cid", "embedding", "list"), nearest_of, "q int, score double, cid long, list int")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    true = found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= NEAR).select("q", "cid", "list")
    true = true.join(coded.select("cid", "codes"), "cid").toArrow()  # NEAR rows for each of them
    if not true.num_rows:
        return
    at, home = true.column("q").to_numpy(), true.column("list").to_numpy()
    full = np.flatnonzero(counts)  # lists without a class are never probed
    place = np.full((len(q), len(counts)), len(full))
    place[:, full] = np.argsort(np.argsort(-(q @ index.centroids[full].T), 1), 1)
    need = np.sort(place[at, home]) + 1
    index.probes = min(len(full), -(-int(need[min(len(need) - 1, int(aim * len(need)))]) * 6 // 5))

    codes = np.stack([np.frombuffer(c, np.uint8) for c in true.column("codes").to_pylist()])
    rough = np.array([index.approximate(q[a : a + 1], int(h), c[None])[0, 0] for a, h, c in zip(at, home, codes)])
    marks = spark.sparkContext.broadcast((index, q, {int(h): (at[home == h], rough[home == h], np.flatnonzero(home == h)) for h in np.unique(home)}))

    def before(batches: Iterable) -> Iterator[dict[str, list]]:
        index, q, of = marks.value
        n = np.zeros(sum(len(m[2]) for m in of.values()), np.int64)
        for batch in batches:
            lists, codes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for h in np.unique(lists):
                if int(h) in of:
                    at, least, marked = of[int(h)]
                    some = np.stack([np.frombuffer(codes[i], np.uint8) for i in np.flatnonzero(lists == h)])
                    each, back = np.unique(at, return_inverse=True)
                    n[marked] += (index.approximate(q[each], int(h), some)[back] >= least[:, None] - 1e-9).sum(1)
        hit = np.flatnonzero(n)
        yield {"mark": hit, "n": n[hit]}

    behind = map_arrow(coded.select("list", "codes"), before, "mark int, n long").groupBy("mark").agg(F.sum("n").alias("n")).toArrow()
    index.shortlist = max(index.shortlist, int(1.2 * np.quantile(behind.column("n").to_numpy(), aim)))


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(cid, embedding, members): distinct vectors; the ``keep`` smallest ids are found before the rows are dealt."""
    w = Window.partitionBy("embedding").orderBy("vec_id")
    least = vectors.distinct().withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep)
    grouped = least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    return grouped.select(F.element_at("members", 1).alias("cid"), "embedding", "members")


def nearest(vectors: DataFrame, query_mod: int = 50, sample: int = 100_000) -> DataFrame:
    """(query_id, rank, vec_id, score) of the NEAR nearest of every row whose id is divisible by ``query_mod``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = given.where(part_rule(given))
    every = written(classes(good, NEAR + 1), "classes")
    n = every.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    width = every.select(F.size("embedding")).first()[0]
    share = min(1.0, min(sample, SAMPLE_NUMBERS // width) / n)
    drawn = every if share == 1 else every.where(F.xxhash64("cid") < int((2 * share - 1) * 2.0**63))
    fitted = drawn.select("cid", "embedding").toArrow().sort_by("cid")  # about ``sample`` rows or SAMPLE_NUMBERS at most
    index = Index.fit(matrix(fitted.column("embedding")), max(1, min(4096, int(n**0.5 / 2)) if n >= 512 else 1))
    fitted_index = spark.sparkContext.broadcast(index)  # bounded by 4096 lists and 256 words a part

    def place(batches: Iterable) -> Iterator[dict[str, list]]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(1)))
                home, codes = fitted_index.value.encode(x)
                yield {"cid": batch.column(0).to_pylist(), "embedding": batch.column(1).to_pylist(), "list": home.tolist(), "codes": [c.tobytes() for c in codes]}

    coded = written(map_arrow(every.select("cid", F.col("embedding").cast("array<double>").alias("embedding")), place, "cid long, embedding array<double>, list int, codes binary"), "coded")
    counts = np.zeros(len(index.centroids), np.int64)
    for row in coded.groupBy("list").count().collect():  # one row per list
        counts[row["list"]] = row["count"]
    asking = good.where(F.pmod("vec_id", F.lit(query_mod)) == 0)
    ask_classes = asking.groupBy("embedding").agg(F.count("*").alias("n")).join(every.select("embedding", "cid"), "embedding")
    ask_classes = written(ask_classes, "asking")
    asked = written(skew_join(asking, ask_classes, "embedding", "n").select("vec_id", "cid").distinct(), "asked")
    blocks, full = np.maximum(1, -(-counts // BLOCK)), np.flatnonzero(counts)
    queries = written(coded.join(ask_classes, "cid", "left_semi").select("cid", "embedding"), "queries")
    audit(index, coded, queries, counts)
    shared = spark.sparkContext.broadcast(index)

    def probe(batches: Iterable) -> Iterator[dict[str, list]]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = full[np.argsort(-(unit(matrix(batch.column(1))) @ index.centroids[full].T), 1)]
            enough = np.cumsum(counts[order], 1) - counts[order] < 16 * NEAR
            take = (np.arange(order.shape[1]) < index.probes) | enough
            out: dict[str, list] = {"qid": [], "q": [], "list": []}
            for cid, q, lists, keep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), order, take):
                for at in lists[keep]:
                    for name, value in zip(out, (cid, q, int(at))):
                        out[name].append(value)
                if len(out["qid"]) > 20_000:
                    yield out
                    out = {k: [] for k in out}
            yield out

    probes = map_arrow(queries, probe, "qid long, q array<double>, list int")
    # A list's queries are cut into chunks and its vectors into blocks; both numbers are the list's own.
    per_list = written(probes.groupBy("list").agg(F.count("*").alias("probes")), "probes")  # at most one row per list
    dealt = np.zeros(len(counts), np.int64)
    for row in per_list.collect():
        dealt[row["list"]] = row["probes"]
    table_of = lambda numbers: F.element_at(F.array(*[F.lit(int(b)) for b in numbers]), F.col("list") + 1)
    chunks = np.maximum(1, -(-dealt // BLOCK))
    upto = lambda numbers: F.explode(F.sequence(F.lit(0), table_of(numbers) - 1))
    probes = probes.withColumn("chunk", F.pmod(F.xxhash64("qid"), table_of(chunks)).cast("int")).withColumn("block", upto(blocks))
    stored = coded.where(table_of(dealt) > 0).withColumn("block", F.pmod(F.xxhash64("cid"), table_of(blocks)).cast("int")).withColumn("chunk", upto(chunks))

    def search(key: tuple, block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(ask):
            return pd.DataFrame({"qid": [], "cid": [], "score": []}).astype({"qid": "int64", "cid": "int64"})
        index, x, cids = shared.value, matrix(list(block["embedding"])), block["cid"].to_numpy()
        codes = np.stack([np.frombuffer(c, np.uint8) for c in block["codes"]])
        out = []
        for low in range(0, len(ask), 256):
            part = ask.iloc[low : low + 256]
            q = matrix(list(part["q"]))
            rough = index.approximate(unit(q), int(key[0]), codes)
            most = min(index.shortlist, len(x))
            least = -np.partition(-rough, most - 1, 1)[:, most - 1]
            for qid, v, r, low_r in zip(part["qid"], q, rough, least):
                s = np.flatnonzero(r >= low_r - 1e-9)  # all with the code of the last one
                score = cosines(np.broadcast_to(v, (len(s), len(v))), x[s])
                best = np.lexsort((cids[s], -score))[: NEAR + 1]
                out.append(pd.DataFrame({"qid": qid, "cid": cids[s][best], "score": score[best]}))
        return pd.concat(out)

    keys = ["list", "block", "chunk"]
    found = stored.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(search, "qid long, cid long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    top = found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= NEAR + 1).drop("__n")
    members = top.join(every.select("cid", "members"), "cid").select("qid", "score", F.explode("members").alias("vec_id"))
    members = members.join(ask_classes.select(F.col("cid").alias("qid"), "n"), "qid")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid"))
    pairs = skew_join(asked, written(members, "members"), "qid", "n").where("query_id <> vec_id").select("query_id", "vec_id", "score").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= NEAR).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
