"""Target-distribution importance resampling (operator 11) by overlap chunking.

A document's features are its runs of one to three consecutive words, hashed to buckets. A bucket's gain is the scaled logarithm of
how much commoner it is in the target texts than in the documents; a document's weight is the sum of its features' gains, and
documents are drawn without replacement by weight plus Gumbel noise that depends on the id alone.

Long texts are split at word boundaries into chunks that carry the n - 1 words after their end: a chunk owns the runs that
start in its own words, so every run is counted once and none is lost at a border. Chunks are rows of a table in the shared
folder, from which both passes (bucket counts, weights) read evenly, however skewed the lengths of texts are; counts and weights
are summed by document. What tasks share is one number for each bucket. Ranks come from sorted ranges and one count for each.

Nulls: a null text has no words; a null id counts as empty text in the noise and comes last among ties. Empty texts have no
features and weight 0. Repeated rows are documents of their own, with ranks next to each other. Empty tables give no rows; without
target texts all targets count as 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.frames import map_arrow, table, text_batches, written

RUN = 3
BUCKETS = 10_000
#: Words that a chunk owns.
CHUNK = 4096
#: Longer words are hashed one by one.
LONG = 64
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def _step(c: np.ndarray) -> np.ndarray:
    """A checksum register after one more zero byte."""
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_BYTE = _step(np.arange(256, dtype=np.uint32))


def _shifts(most: int) -> np.ndarray:
    """For 0..most bytes to come: what each byte of a checksum so far adds to the checksum of the whole."""
    rows = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(most):
        c = rows[-1]
        rows.append(_BYTE[c & np.uint32(255)] ^ (c >> np.uint32(8)))
    return np.concatenate(rows)


_SHIFT = _shifts(LONG + 1)


def _shifted(crc: np.ndarray, more: np.ndarray) -> np.ndarray:
    at = more.astype(np.int64) * 1024
    return _SHIFT[at + (crc & 255)] ^ _SHIFT[at + 256 + (crc >> 8 & 255)] ^ _SHIFT[at + 512 + (crc >> 16 & 255)] ^ _SHIFT[at + 768 + (crc >> 24)]


_SPACED = _shifted(np.full(LONG + 1, zlib.crc32(b" "), np.uint32), np.arange(LONG + 1))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of lower-cased UTF-8."""
    edge = np.zeros(len(data) + 2, bool)
    edge[1:-1] = WORD[np.frombuffer(data, np.uint8)]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    return turns[0::2], turns[1::2]


def run_checksums(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For 1..RUN words: the CRC-32 of the words from each one on, joined by one space, as if there were always words enough.

    The checksum of a joined text follows from those of its parts, so every word is read once.
    """
    raw, sizes = np.frombuffer(data, np.uint8), ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(sizes <= LONG)
    for j in range(int(sizes[left].max()) if len(left) else 0):
        left = left[sizes[left] > j]
        now = crc[left]
        crc[left] = _BYTE[(now ^ raw[starts[left] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    long = np.flatnonzero(sizes > LONG).tolist()
    for k in long:
        crc[k] = zlib.crc32(data[starts[k] : ends[k]])
    short = np.minimum(sizes, LONG)
    spaced = _SPACED[short] ^ crc
    out = [crc]
    for n in range(1, RUN):
        before, last = out[-1], slice(n, None)
        made = np.zeros(len(crc), np.uint32)
        many = max(0, len(crc) - n)
        made[:many] = _shifted(before[:many], short[last] + 1) ^ spaced[last]
        for k in long:
            if k >= n:
                made[k - n] = zlib.crc32(b" " + data[starts[k] : ends[k]], int(before[k - n]))
        out.append(made)
    return out


def features(texts: list[str], own: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, place of its text in the list) of all features that start in a text's first ``own`` words (None: in any), and how
    many such words each text has."""
    data = b"\0".join(t.encode("utf-8", "surrogatepass").lower() for t in texts)
    starts, ends = word_places(data)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.arange(len(starts)) - first[owner]
    most = np.array([np.iinfo(np.int64).max if o is None else o for o in own])
    mine = place < most[owner]
    found, whose = [], []
    for n, crc in enumerate(run_checksums(data, starts, ends)):
        there = mine & (place + n < counts[owner])
        found.append(crc[there] % np.uint32(BUCKETS))
        whose.append(owner[there])
    return np.concatenate(found), np.concatenate(whose), np.minimum(counts, most)


def chunks(texts: DataFrame, key: str | None = None, words: int = CHUNK) -> DataFrame:
    """(row, key, own, text): every text in pieces of ``words`` words and the RUN - 1 words after them. ``row`` tells the input's rows apart."""
    source = texts.select((F.lit(None) if key is None else F.col(key)).cast("long").alias("key"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        row = TaskContext.get().partitionId() << 33
        for columns, lot in text_batches(batches):
            out: dict[str, list] = {"row": [], "key": [], "own": [], "text": []}

            def add(key: int | None, own: int | None, text: str) -> None:
                for name, value in zip(out, (row, key, own, text)):
                    out[name].append(value)

            for key, text in zip(columns["key"], lot):
                row += 1
                if len(text) < words:
                    add(key, None, text)
                    continue
                data = text.encode("utf-8", "surrogatepass")
                starts, ends = word_places(data.lower())
                for low in range(0, max(1, len(starts)), words):
                    high = min(low + words + RUN - 1, len(starts))
                    piece = data[starts[low] : ends[high - 1]] if len(starts) else b""
                    add(key, words, piece.decode("utf-8", "surrogatepass"))
            yield out

    return map_arrow(source, run, "row long, key long, own int, text string")


def bucket_counts(pieces: DataFrame) -> DataFrame:
    """(bucket, n) of all features; one row for each bucket that a task has seen leaves it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        total = np.zeros(BUCKETS, np.int64)
        for columns, lot in text_batches(batches):
            total += np.bincount(features(lot, columns["own"])[0], minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield {"bucket": there, "n": total[there]}

    return map_arrow(pieces.select("own", "text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, from the bucket counts of both sides: BUCKETS numbers."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for counts, into in ((documents, s), (target, t)):
        for r in counts.collect():  # at most BUCKETS rows
            into[r.bucket] = r.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))))


def weigh(pieces: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, key, n_words, n_features, weight) of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for columns, lot in text_batches(batches):
            bucket, owner, words = features(lot, columns["own"])
            count = np.bincount(owner, minlength=len(lot))
            weight = np.bincount(owner, gain[bucket], minlength=len(lot))
            yield {"row": columns["row"], "key": columns["key"], "n_words": words, "n_features": count, "weight": np.rint(weight).astype(np.int64)}

    made = map_arrow(pieces, run, "row long, key long, n_words long, n_features long, weight long")
    return made.groupBy("row").agg(F.max("key").alias("key"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def noise(key: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def in_order(df: DataFrame, *order: Column, rows_per_part: int = 500_000, name: str = "rank") -> DataFrame:
    """``df`` with its rows numbered from 1 in the given order: sorted ranges, and one count of rows for each."""
    parts = max(1, math.ceil(df.count() / rows_per_part))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranges")
    before, found = 0, []
    for r in sorted(dealt.groupBy("__part").count().collect(), key=lambda r: r["__part"]):  # one row for each range
        found.append((r["__part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(found, "__part int, __before long")
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, key: str = "doc_id", words: int = CHUNK, rows_per_part: int = 500_000) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document. Of those with ``least_words`` words, the ``percent``
    hundredths of highest scores are drawn: rank numbers them, and is null for all others."""
    pieces = written(chunks(docs, key, words), "chunks")
    gain = gains(bucket_counts(pieces), bucket_counts(chunks(target, None, words)))
    weights = written(weigh(pieces, gain).withColumn("score", F.col("weight") + noise(F.col("key"))), "weights")
    long = weights.where(F.col("n_words") >= least_words)
    ranked = in_order(long, F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("row"), rows_per_part=rows_per_part)
    drawn = percent * long.count() // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = weights.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionAll(rest.select(columns))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: A checksum is the exclusive or of what each byte adds, by how many bytes follow it, so it is a join and an aggregation.
OP11_SQL = """
with recursive texts as (select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
split as (select row_number() over () as r, side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from texts),
sized as (select r, side, id, len(ws) as n_words from split),
runs as (
  select r, side, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]), list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2]))) as x from split),
one as (select b, list_reduce(list_prepend(b, range(8)), lambda s, k: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end) as c from range(256) t(b)),
most as (select coalesce(max(strlen(x)), 0) as n from runs),
moved as (select b, 0 as d, c from one union all select m.b, d + 1, xor(m.c >> 8, one.c) from moved m join one on one.b = m.c & 255, most where d < most.n),
begun as (select 0 as d, 4294967295 as c union all select d + 1, xor(g.c >> 8, one.c) from begun g join one on one.b = g.c & 255, most where d < most.n),
spelt as (select x, hex(x) as h, strlen(x) as n, unnest(range(strlen(x))) as k from (select distinct x from runs)),
hashed as (
  select s.x, (4294967295 - xor(any_value(g.c), bit_xor(m.c))) % 10000 as bucket
  from spelt s join moved m on m.b = ('0x' || substr(s.h, 2 * s.k + 1, 2))::bigint and m.d = s.n - 1 - s.k join begun g on g.d = s.n group by s.x),
counted as (select h.bucket, r.side, r.r, count(*) as n from runs r join hashed h on h.x = r.x group by all),
sides as (select bucket, sum(n) filter (side = 0) as s, sum(n) filter (side = 1) as t from counted group by bucket),
totals as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from sides),
gains as (select bucket, floor(1000 * ln((coalesce(a.t, 0) + 1)::double * (b.s + 10000) / ((coalesce(a.s, 0) + 1)::double * (b.t + 10000)))) as gain from sides a, totals b),
weighed as (
  select d.id as doc_id, d.n_words, cast(coalesce(sum(c.n), 0) as bigint) as n_features, cast(coalesce(sum(c.n * g.gain), 0) as bigint) as weight,
    ('0x' || substr(sha256('42:' || coalesce(d.id::varchar, '')), 1, 8))::bigint as h
  from sized d left join counted c on c.r = d.r left join gains g on g.bucket = c.bucket where d.side = 0 group by d.r, d.id, d.n_words),
scored as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from weighed),
ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as place, count(*) over (partition by n_words >= 20) as n from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * n // 100 then place end as rank from ranked
"""
