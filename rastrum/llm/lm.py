"""Language-model scoring (operator 3): a log-bilinear neural model.

The three tokens before a token are summed into one prediction, x = sum_j c_j * r_(u_j), with a vector r of each context
token and a diagonal map c_j of each position. Tokens are the ``vocabulary`` commonest and ``buckets`` of all others,
told apart by their endings; inside a bucket tokens share its probability by their smoothed counts. P(w | x) is
P(class of w | x) P(w | class, x), each a softmax of q . x + b, so batches of texts need products with one matrix of
classes and one of each class's tokens (some sqrt(ids) columns each), and the probabilities of all tokens sum to one.

Learning is by noise-contrastive estimation in numpy, on Spark's partitions, from every token of all
training texts. Blocks of 64 tokens are a table; in each round every task starts from the same parameters, learns from its blocks, and sends what changed;
the changes are averaged by how often each row was met. The first rounds set tokens against draws from all token
frequencies; then the tokens are halved by the main direction of their vectors until there are sqrt(ids) classes, and the other
rounds learn classes against classes and tokens against their class. The driver holds parameters (2 ids + classes rows),
never windows. The ``most_frequent`` commonest tokens' counts travel with the code (fixed bound); the rest are joined by
token, where no key can be hot because the hot ones are in the first part.

Nulls: a null text counts as empty, a null doc_id as the empty text in the fold rule. An empty text
is one end token. Without training documents every token has probability by smoothing alone.
Repeated rows are scored each by itself. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.frames import crc_mod, map_arrow, table, text_batches, written
from rastrum.llm.words import lowered, mix

END = b""  # no word is empty
END_ID = 0
#: Tokens before a token that its probability depends on.
POSITIONS = 3
#: Consecutive tokens that are drawn for learning together.
BLOCK = 64
DIM = 16
#: Last bytes of a token that choose its bucket.
ENDING = 3


def count_tokens(docs: DataFrame, most_held: int = 300_000) -> DataFrame:
    """(token binary, n long): counts of every token of every text, one end for each text."""

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        seen: Counter[bytes] = Counter()
        for _, texts in text_batches(batches):
            for t in texts:
                seen.update(lowered(t).split())
            seen[END] += len(texts)
            if len(seen) >= most_held:
                yield {"token": list(seen), "n": list(seen.values())}
                seen.clear()
        if seen:
            yield {"token": list(seen), "n": list(seen.values())}

    return map_arrow(docs.select("text"), run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Ids:
    """Ids of the network: the end, the commonest tokens, then the buckets of all others."""

    known: dict[bytes, int]
    buckets: int

    @property
    def size(self) -> int:
        return len(self.known) + self.buckets

    def bucket(self, token: bytes) -> int:
        return zlib.crc32(token[-ENDING:]) % self.buckets

    def of(self, tokens: list[bytes]) -> list[int]:
        get, first = self.known.get, len(self.known)
        return [first + self.bucket(w) if (i := get(w)) is None else i for w in tokens]


def draw_blocks(docs: DataFrame, ids: Ids, share: float) -> DataFrame:
    """(ids array<int>): one in ``share`` blocks of all texts, chosen by checksums, each behind the POSITIONS ids before it."""
    below = int((1 << 53) / share)
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        ids = shared.value
        for _, texts in text_batches(batches):
            out = []
            for t in texts:
                data = lowered(t)
                seen = data.split()
                blocks = np.arange(len(seen) // BLOCK + 1, dtype=np.uint64)
                drawn = mix(blocks * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(data) + 1)) >> np.uint64(11) < below
                for low in (np.flatnonzero(drawn) * BLOCK).tolist():
                    line = [END_ID] * max(POSITIONS - low, 0) + ids.of(seen[max(low - POSITIONS, 0) : low + BLOCK])
                    out.append([*line, END_ID] if low + BLOCK > len(seen) else line)
            yield {"ids": out}

    return map_arrow(docs.select("text"), run, "ids array<int>")


def windows(batch: pa.RecordBatch) -> np.ndarray:
    """(context ids, nearest first, then the id that they precede) of all places of a batch of blocks."""
    lists = batch.column(0)
    flat, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    place = np.arange(len(flat)) - np.repeat(edges[:-1], np.diff(edges))
    at = np.flatnonzero(place >= POSITIONS)
    return np.stack([*(flat[at - 1 - j] for j in range(POSITIONS)), flat[at]], 1)


@dataclass
class Classes:
    """Tokens by class: class k has order[edges[k] : edges[k + 1]]."""

    order: np.ndarray
    edges: np.ndarray

    def __post_init__(self) -> None:
        self.of, self.place = np.empty((2, len(self.order)), np.int64)
        self.of[self.order] = np.repeat(np.arange(len(self)), np.diff(self.edges))
        self.place[self.order] = np.arange(len(self.order)) - np.repeat(self.edges[:-1], np.diff(self.edges))

    def __len__(self) -> int:
        return len(self.edges) - 1


def halved(vectors: np.ndarray, weight: np.ndarray) -> Classes:
    """About sqrt(n) classes of equally many tokens: halves along the direction in which weighted vectors differ most."""
    parts = [np.arange(len(vectors))]
    for _ in range(int(np.log2(max(len(vectors), 1)) / 2)):
        cut = []
        for rows in parts:
            x, m = vectors[rows].astype(float), weight[rows, None]
            x = x - (x * m).sum(0) / m.sum()
            rows = rows[np.argsort(x @ np.linalg.eigh((x * m).T @ x)[1][:, -1], kind="stable")]
            cut += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
        parts = cut
    return Classes(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their values, and how often each occurs."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0), np.diff(np.append(first, len(rows)))


class LogBilinear:
    """Parameters as rows of one matrix (vector, bias): contexts, tokens, position maps, then classes if there are any."""

    def __init__(self, p: np.ndarray, seed: int = 3) -> None:
        self.v, self.p, self.classes = len(p), p, None
        self.rows = np.zeros((2 * self.v + POSITIONS, DIM + 1), np.float32)
        self.rows[: self.v, :DIM] = np.random.default_rng(seed).normal(0, 0.3, (self.v, DIM))
        self.rows[self.v : 2 * self.v, DIM] = np.log(p)
        self.rows[2 * self.v :, :DIM] = np.array([1.0, 0.7, 0.5])[:, None]
        self.seen = np.full(len(self.rows), 1e-8)

    def divide(self) -> None:
        """Classes from the tokens' vectors; predictions that don't depend on the context stay as they are."""
        tokens = self.rows[self.v : 2 * self.v]
        self.classes = halved(tokens[:, :DIM], np.sqrt(self.p))
        self.p_class = np.add.reduceat(self.p[self.classes.order], self.classes.edges[:-1])
        tokens[:, DIM] -= np.log(self.p_class)[self.classes.of]
        more = np.zeros((len(self.classes), DIM + 1), np.float32)
        more[:, DIM] = np.log(self.p_class)
        self.rows, self.seen = np.concatenate([self.rows, more]), np.concatenate([self.seen, np.full(len(more), 1e-8)])

    def log_probabilities(self, at: np.ndarray, most: int = 1 << 15) -> np.ndarray:
        """Natural log P of the last id of each window given those before it: some windows at a time, all of a class together."""
        out = np.empty(len(at))
        tokens, classes = self.rows[self.v : 2 * self.v], self.rows[2 * self.v + POSITIONS :]
        mapped = [self.rows[: self.v] * c for c in self.rows[2 * self.v : 2 * self.v + POSITIONS]]
        for j, m in enumerate(mapped):  # the bias column is met by a one
            m[:, DIM] = 1 if j == 0 else 0
        of, place = self.classes.of.astype(np.int16), self.classes.place
        inside = [tokens[self.classes.order[low:high]].T.copy() for low, high in zip(self.classes.edges, self.classes.edges[1:])]
        classes = classes.T.copy()
        for low in range(0, len(at), most):
            part = at[low : low + most]
            k = of[part[:, POSITIONS]]
            order = np.argsort(k, kind="stable")
            part, k = part[order], k[order]
            x = sum(np.take(m, part[:, j], 0) for j, m in enumerate(mapped))
            got = log_softmax(x, classes, k)
            p, edges = place[part[:, POSITIONS]], np.searchsorted(k, np.arange(len(inside) + 1))
            for j in np.flatnonzero(np.diff(edges)):
                rows = slice(edges[j], edges[j + 1])
                got[rows] += log_softmax(x[rows], inside[j], p[rows])
            out[low + order] = got
        return out


def log_softmax(x: np.ndarray, columns: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the normalised exp(x @ columns) at one column of each row; the largest is taken off where exp could overflow."""
    s = x @ columns
    if (x * x).sum(1).max() * (columns * columns).sum(0).max() > 80**2:
        s -= s.max(1, keepdims=True)
    mine = s[np.arange(len(s)), at].astype(float)
    return mine - np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32))


class Learner:
    """Noise-contrastive estimation by Adagrad with one scale for each row."""

    def __init__(self, model: LogBilinear, rate: float, seed: int, batch: int = 512, noise: int = 64) -> None:
        self.model, self.rate, self.batch, self.noise = model, rate, batch, noise
        self.rng = np.random.default_rng(seed)
        self.rows, self.seen, self.met = model.rows.copy(), model.seen.copy(), np.zeros(len(model.rows))

    def draw(self, upto: np.ndarray) -> np.ndarray:
        """Places of ``noise`` draws from probabilities whose running sums are ``upto``."""
        return np.minimum(np.searchsorted(upto, self.rng.random(self.noise) * upto[-1], "right"), len(upto) - 1)

    def learn(self, at: np.ndarray) -> None:
        """One pass over windows, in an order of its own."""
        m = self.model
        at = at[self.rng.permutation(len(at))]
        before, w = at[:, :POSITIONS], at[:, POSITIONS]
        level, upto = np.log(self.noise * m.p), np.cumsum(m.p)
        pieces = [(slice(low, low + self.batch), -1) for low in range(0, len(at), self.batch)]
        if m.classes is None:
            for rows, _ in pieces:
                self.step(before[rows], m.v, w[rows], self.draw(upto), level)
            return
        k = m.classes.of[w]
        order = np.argsort(k, kind="stable")
        edges = np.searchsorted(k[order], np.arange(len(m.classes) + 1))
        pieces += [(order[low : min(low + self.batch, edges[j + 1])], j) for j in range(len(m.classes)) for low in range(edges[j], edges[j + 1], self.batch)]
        level -= np.log(m.p_class)[m.classes.of]
        level_class, upto_class = np.log(self.noise * m.p_class), np.cumsum(m.p_class)
        members = [m.classes.order[low:high] for low, high in zip(m.classes.edges, m.classes.edges[1:])]
        uptos = [np.cumsum(m.p[rows]) for rows in members]
        for i in self.rng.permutation(len(pieces)):
            rows, j = pieces[i]
            if j < 0:
                self.step(before[rows], 2 * m.v + POSITIONS, k[rows], self.draw(upto_class), level_class)
            else:
                self.step(before[rows], m.v, w[rows], members[j][self.draw(uptos[j])], level)

    def step(self, before: np.ndarray, first: int, w: np.ndarray, against: np.ndarray, level: np.ndarray) -> None:
        """Ids ``w`` behind ``before`` stand against the drawn ones; ``level`` is the log of how often an id is drawn, its row is ``first`` on."""
        n, n_w = len(w), len(w) + len(against)
        r, c = self.rows[before, :DIM], self.rows[2 * self.model.v : 2 * self.model.v + POSITIONS, :DIM]
        x = np.ones((n, DIM + 1), np.float32)
        np.sum(r * c, 1, out=x[:, :DIM])
        q, z = self.rows[first + w], self.rows[first + against]
        good = (-1 / (1 + np.exp(np.clip(np.einsum("bd,bd->b", x, q) - level[w], -30, 30)))).astype(np.float32)
        bad = 1 / (1 + np.exp(np.clip(level[against].astype(np.float32) - x @ z.T, -30, 30)))
        d = good[:, None] * q + bad @ z
        d[:, DIM] = 0
        grad = np.zeros((n_w + n * POSITIONS, DIM + 1), np.float32)
        np.multiply(good[:, None], x, out=grad[:n])
        np.matmul(bad.T, x, out=grad[n:n_w])
        np.multiply(d[:, None, :DIM], c, out=grad[n_w:].reshape(n, POSITIONS, DIM + 1)[:, :, :DIM])
        rows, grad, met = row_sums(np.concatenate([first + w, first + against, before.ravel()]), grad)
        to_c = np.zeros((POSITIONS, DIM + 1), np.float32)
        to_c[:, :DIM] = (d[:, None, :DIM] * r).sum(0)
        self.change(rows, grad, self.rate, met)
        self.change(2 * self.model.v + np.arange(POSITIONS), to_c, 0.1 * self.rate, 1)

    def change(self, rows: np.ndarray, grad: np.ndarray, rate: float, n: np.ndarray | int) -> None:
        self.seen[rows] += np.einsum("rd,rd->r", grad, grad) / (DIM + 1)
        self.rows[rows] -= grad * (rate / np.sqrt(self.seen[rows]))[:, None].astype(np.float32)
        self.met[rows] += n


def learn_round(blocks: DataFrame, model: LogBilinear, rate: float, number: int, most_held: int = 1 << 20) -> None:
    """One round on all blocks: each task's changes of the rows that it met, averaged by how often it met them."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        model = shared.value
        learner = Learner(model, rate, 1000 * TaskContext.get().partitionId() + number)
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(windows(batch))
            if sum(map(len, held)) >= most_held:
                learner.learn(np.concatenate(held))
                held = []
        if held:
            learner.learn(np.concatenate(held))
        met = np.flatnonzero(learner.met)
        yield {"row": met, "n": learner.met[met], "g": learner.seen[met] - model.seen[met], "v": list(learner.rows[met] - model.rows[met])}

    changes = map_arrow(blocks, run, "row int, n double, g double, v array<float>")
    sums = changes.groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("g"), *(F.sum(F.col("n") * F.col("v")[k]).alias(f"v{k}") for k in range(DIM + 1)))
    got = sums.toArrow()  # at most one row for each of the model's
    row, n = got["row"].to_numpy(), got["n"].to_numpy()
    model.seen[row] += got["g"].to_numpy() / n
    model.rows[row] += np.stack([got[f"v{k}"].to_numpy() / n for k in range(DIM + 1)], 1).astype(np.float32)
    shared.destroy()


def fit(blocks: DataFrame, p: np.ndarray, rates: tuple[float, ...] = (0.03,), class_rates: tuple[float, ...] = (0.06,)) -> LogBilinear:
    """A round for each rate: tokens against all tokens, then by classes. ``p`` are the ids' shares of the corpus, none zero."""
    model = LogBilinear(p)
    for i, rate in enumerate(rates):
        learn_round(blocks, model, rate, i)
    model.divide()
    for i, rate in enumerate(class_rates):
        learn_round(blocks, model, rate, len(rates) + i)
    return model


def frequent_threshold(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` tokens reach it; from a histogram of at most a few hundred rows."""
    bucket = F.floor(F.log2("n") * 8).cast("int")
    bars = counts.groupBy(bucket.alias("bar")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect()
    total, least = 0, 1 << 62
    for bar in sorted(bars, key=lambda b: -b["bar"]):
        total += bar["k"]
        if total > most:
            break
        least = bar["least"]
    return least


def score_texts(docs: DataFrame, vocabulary: int = 15_872, buckets: int = 512, most_frequent: int = 200_000, held_fold: tuple[int, int] = (7, 2)) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; every training token is learnt from."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (crc_mod("doc_id", held_fold[0]) == held_fold[1]).alias("held_out"))
    learn = docs.where(~F.col("held_out"))
    counts = written(count_tokens(learn), "tokens")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total["n"], total["v"]
    # The end is in the table of common tokens however rare it is.
    frequent = (F.col("n") >= frequent_threshold(counts, most_frequent)) | (F.col("token") == F.lit(END))
    got = counts.where(frequent).toArrow()
    common = dict(zip(got["token"].to_pylist(), got["n"].to_pylist()))
    top = sorted((w for w in common if w != END), key=lambda w: (-common[w], w))[: vocabulary - 1]
    ids = Ids({w: i for i, w in enumerate([END, *top])}, buckets)
    ends = F.substring("token", -ENDING, ENDING)
    totals = np.ones(buckets)  # one for all tokens that training never met
    for row in counts.groupBy(F.pmod(F.crc32(ends), F.lit(buckets)).alias("bucket")).agg(F.sum(F.col("n") + 1).alias("n")).collect():  # one row per bucket
        totals[row["bucket"]] += row["n"]
    for w in ids.known:
        totals[ids.bucket(w)] -= common[w] + 1 if w in common else 0
    # The ids' shares, half a token more for each
    n_ids = np.full(ids.size, 0.5)
    n_ids[: len(ids.known)] += [common.get(w, 0) for w in ids.known]
    n_ids[len(ids.known) :] += np.maximum(totals - 1, 0)
    # About 2^20 windows to a file; each is a task's
    blocks = written(draw_blocks(learn, ids, 1.0).repartition(max(1, n_all >> 20)), "blocks")
    model = fit(blocks, n_ids / n_ids.sum())
    rest = counts.where(~frequent)
    facts = spark.sparkContext.broadcast((model, ids, common, np.log10(totals)))

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        model, ids, common, log_totals = facts.value
        row = TaskContext.get().partitionId() << 40
        # Codes of the common tokens, the end first; what each means to the network and to the base
        code = {w: i for i, w in enumerate([END, *(w for w in common if w != END)])}
        id_of = np.array(ids.of(list(code)))
        log_of = np.array([np.log10(common.get(w, 0) + 1) for w in code])
        known_of = np.array([w in common for w in code])
        inside_of = np.where(id_of < len(ids.known), 0.0, log_of) - np.append(np.zeros(len(ids.known)), log_totals)[id_of]
        for columns, texts in text_batches(batches):
            flat: list[int] = []
            n_tokens, rare = [], []
            first: dict[bytes, int] = {}  # rare tokens of this slice get the codes after the common ones
            for t in texts:
                seen = lowered(t).split()
                codes = [code.get(w, -1) for w in seen]
                other: Counter[bytes] = Counter()
                if -1 in codes:
                    for i, c in enumerate(codes):
                        if c < 0:
                            other[seen[i]] += 1
                            codes[i] = first.setdefault(seen[i], len(code) + len(first))
                flat += [0] * POSITIONS
                flat += codes
                flat.append(0)
                n_tokens.append(len(seen) + 1)
                rare.append([{"token": w, "n": n} for w, n in other.items()])
            id_all = np.append(id_of, ids.of(list(first))).astype(np.int64)
            edges = np.cumsum([0, *n_tokens])
            line = np.array(flat)
            at = np.arange(edges[-1]) + POSITIONS * np.repeat(np.arange(1, len(texts) + 1), n_tokens)
            w, of = line[at], id_all[line]
            none = np.zeros(len(first))
            chance = model.log_probabilities(np.stack([*(of[at - 1 - j] for j in range(POSITIONS)), of[at]], 1)) / np.log(10)
            chance += np.append(inside_of, none - log_totals[id_all[len(code) :] - len(ids.known)])[w]
            yield columns | {
                "uid": np.arange(row, row + len(texts)),
                "n_tokens": n_tokens,
                "n_known": np.add.reduceat(np.append(known_of, none)[w].astype(np.int64), edges[:-1]),
                "base": np.add.reduceat(np.append(log_of, none)[w], edges[:-1]),
                "score": np.add.reduceat(chance, edges[:-1]),
                "rare": rare,
            }
            row += len(texts)

    scored = written(
        map_arrow(docs, run, "doc_id long, held_out boolean, uid long, n_tokens long, n_known long, base double, score double, rare array<struct<token: binary, n: int>>"),
        "scored",
    )
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.token", F.col("r.n").alias("k"))
    sums = (
        rare.join(rest, "token", "left")
        .groupBy("uid")
        .agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("add"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known"))
    )
    whole = scored.drop("rare").join(sums, "uid", "left")
    add = F.coalesce("add", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
        (F.col("score") + add).alias("score"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
