"""Packing of documents into token windows (operator 8).

Each partition of the input is one ordered stream of tokens. A dynamic program over document and
sentence ends (and forced places inside overlong sentences) chooses the window cuts that minimise
padding plus a penalty for each document that a cut splits. The cost of a window is linear in its
ends, so the best earlier cut is the minimum of a sliding range and a monotone queue keeps it:
linear time. Windows whose length is a power of two need no padding, so those lengths are tried too.
Streams are solved in blocks; the last, open window of a block moves on into the next block, so the
memory is bounded by the block and not by the partition. There is no shuffle.

Nulls: a null text counts as empty; an empty document is its closing id alone. A null doc_id is kept.
Repeated rows are packed each by itself. Documents longer than a window are cut as often as needed.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from rastrum.llm.bpe import byte_characters
from rastrum.llm.frames import map_arrow, table, text_batches

#: Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteBpe:
    """Ids of a byte-level tokenizers file, and which of them end a sentence."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in special.items():
            ranks.pop(content.encode(), None) if ranks.get(content.encode()) == i else None
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        self.ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for token, i in ranks.items():
            self.ends[i] = token.endswith((b".", b"!", b"?", b"\n"))

    def encode(self, text: str) -> np.ndarray:
        known = {s for s in self.special if s in text}
        return self.encoding.encode_to_numpy(text, allowed_special=known, disallowed_special=())


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def candidate_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int, penalties: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending, and the penalty of each."""
    places = np.union1d(doc_ends, sentence_ends)
    gaps = np.diff(np.concatenate([[0], places]))
    step = max(1, window // 8)
    wide = np.flatnonzero(gaps > step)
    forced = [np.arange(places[k] - gaps[k] + step, places[k], step) for k in wide]
    forced = np.concatenate(forced) if forced else np.zeros(0, np.int64)
    every = np.union1d(places, forced)
    cost = np.full(len(every), penalties[1], np.int64)
    cost[np.searchsorted(every, sentence_ends)] = penalties[0]
    cost[np.searchsorted(every, doc_ends)] = 0
    return every, cost


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Window ends of least total cost; the last place always ends a window."""
    at = [0, *places.tolist()]
    cost = [0, *penalty.tolist()]
    powers = [1 << k for k in range((window - 1).bit_length()) if 1 << k < window and 1 << k >= window // 16]
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        value += window - here
        for size in powers:
            k = bisect_left(at, here - size, 0, j)
            if at[k] == here - size and best[k] < value:
                value, i = best[k], k
        value += cost[j] + 1
        best[j], back[j] = value, i
        key = value + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def split_tail(length: int, window: int, penalty: int) -> list[int]:
    """The last window of a stream as powers of two, where their cuts cost less than its padding."""
    sizes = [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]
    return sizes if (len(sizes) - 1) * penalty < window - length else [length]


class Stream:
    """Documents of one partition on their way into windows."""

    def __init__(self, first_id: int, window: int, penalties: tuple[int, int], block: int):
        self.window, self.penalties, self.block = window, penalties, block
        self.next_id = first_id
        self.docs: list[tuple[int | None, np.ndarray, np.ndarray, int]] = []  # id, ids, sentence ends, ids before
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, ends, 0))
        self.size += len(ids)
        return self.solve(False) if self.size >= self.block else []

    def solve(self, last: bool) -> list[tuple]:
        if not self.size:
            return []
        lengths = np.array([len(d[1]) - d[3] for d in self.docs])
        doc_ends = np.cumsum(lengths)
        bases = doc_ends - lengths
        inner = [e[e > d[3]] - d[3] + b for d, e, b in zip(self.docs, (d[2] for d in self.docs), bases)]
        cuts = best_cuts(*candidate_cuts(doc_ends, np.concatenate(inner), self.window, self.penalties), self.window)
        if last:
            tail = cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)
            cuts = [*cuts[:-1], *(cuts[-1] - tail + np.cumsum(split_tail(tail, self.window, self.penalties[1]))).tolist()]
        elif len(cuts) > 1:
            cuts = cuts[:-1]
        rows, k, begun = [], 0, 0
        for cut in cuts:
            at = begun
            while at < cut:
                doc_id, ids, _, before = self.docs[k]
                start = before + at - int(bases[k])
                size = min(cut, int(doc_ends[k])) - at
                piece = ids[start : start + size].astype("<u4").tobytes()
                rows.append((doc_id, start, size, zlib.crc32(piece), len(ids), self.next_id, at - begun))
                at += size
                if at == doc_ends[k]:
                    k += 1
            begun = cut
            self.next_id += 1
        rest = self.docs[k:]
        if rest:
            doc_id, ids, ends, before = rest[0]
            rest[0] = (doc_id, ids, ends, before + begun - int(bases[k]))
        self.docs, self.size = rest, int(doc_ends[-1]) - begun
        return rows


def pack(
    docs: DataFrame,
    path: str,
    window: int = 2048,
    close_id: int = 1,
    penalties: tuple[int, int] = (8, 64),
    block: int = 1 << 20,
) -> DataFrame:
    """One row per piece of a document. ``penalties``: of a cut at a sentence end, and anywhere else."""

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        bpe = byte_bpe(path)
        stream = Stream(TaskContext.get().partitionId() << 40, window, penalties, block)
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def out(rows: list[tuple]) -> dict[str, list]:
            return dict(zip(names, map(list, zip(*rows))))

        for columns, texts in text_batches(batches):
            rows = []
            for doc_id, text in zip(columns["doc_id"], texts):
                ids = bpe.encode(text)
                ends = np.flatnonzero(bpe.ends[ids]) + 1
                rows += stream.add(doc_id, np.append(ids, np.uint32(close_id)), ends)
            if rows:
                yield out(rows)
        if rows := stream.solve(True):
            yield out(rows)

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
