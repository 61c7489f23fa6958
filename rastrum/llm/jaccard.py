"""N-gram Jaccard join (operator 5): a size-aware heavy-light set join.

A document's set is its distinct 5-word shingles. Equal sets are one class. Shingles are ordered rare first
(frequent ones come from summaries of all partitions; any fixed order is exact, this one keeps lists short). Two
sets that link share c shingles among the first (size - least overlap + c) of each. Small sets
enumerate the 2-subsets of that prefix, so that they meet on pairs of shingles; large sets, and small ones that could
link with a large one, are entered in inverted lists (c = 1). The boundary is where
enumerating begins to cost more than scanning lists. Candidates are verified by exact intersection.

Only components are asked for, so links inside a known component need no check. Round one compares
each set with the leader of most of its lists. Round two takes all pairs that share a list but not yet a component,
drops those whose prefixes rule the threshold out, and verifies the rest: no link between components is lost, and a large group
of near copies costs about one check per member.

Nulls: null or blank texts have no shingles and link with nothing; a null doc_id is never a component id
(null if its group has no other). Repeated rows give equal rows. Fewer than 5 words are one shingle. Empty tables
give no rows; other columns are ignored. Set and shingle identity is by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastrum.llm.frames import LAST_ID, components, map_arrow, own_names, skew_join, table, text_batches, written
from rastrum.llm.lm import frequent_threshold
from rastrum.llm.words import lowered, mix, shingle_hashes, word_hashes

MOST_BROADCAST = 400_000
#: A set of n shingles enters 1 + n // SPARE more of them in lists than it could miss, so linked sets share that many.
SPARE = 24
#: Lists of this many sets or more compare bitmaps of whole sets before they make a pair.
LONG_LIST = 8


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(lowered(text))[2], size))


def frequent_shingles(docs: DataFrame, size: int, local: int = 4) -> DataFrame:
    """(token long, n long): sums over batches of texts of the shingles in at least ``local`` texts of a batch."""

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        for _, texts in text_batches(batches, 8_000_000):
            sets = [shingle_set(t, size) for t in texts]
            if not sets:
                continue
            every = np.sort(np.concatenate(sets))
            # of equal hashes in a row: those whose local-th follower is still equal
            at = np.flatnonzero(every[: len(every) - local + 1] == every[local - 1 :]) if len(every) >= local else []
            tokens, extra = np.unique(every[at], return_counts=True)
            yield {"token": tokens.view(np.int64), "n": extra + local - 1}

    return map_arrow(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def bitmap(shingles: np.ndarray) -> np.ndarray | None:
    """Which of 1024 places (4096 from 257 shingles on, none from 1025 on) hold a shingle, as 64-bit words.

    A place that one set holds and another doesn't stands for at least one shingle that they don't share.
    """
    if len(shingles) > 1024:
        return None
    size = 1024 if len(shingles) <= 256 else 4096
    held = np.zeros(size, np.uint8)
    held[(shingles % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(held).view("<i8")


def beyond(a: Column, b: Column) -> Column:
    """How many places of bitmap ``a`` aren't in ``b``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, k: n + k)


def light_boundary(list_length: float) -> int:
    """Largest size at which the 2-subsets of a prefix are no more than its entries and the scans they save.

    A prefix holds about a quarter of the set, so n/4 + 2 choose 2 subsets stand against n/4 + 1
    entries that are each scanned with ``list_length`` others.
    """
    n = 4
    while (n // 4 + 2) * (n // 4 + 1) / 2 <= (n // 4 + 1) * (1 + list_length) and n < 64:
        n += 1
    return n


def prefix_length(n: int) -> int:
    """How many of a set's first shingles are entered in lists."""
    return n - -(-3 * n // 4) + 1 + n // SPARE


def signature(ordered: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of a set in the global order; the position is -1 for keys of two shingles."""
    n = len(ordered)
    slack = n - -(-3 * n // 4)
    keys, places = [], []
    if n > boundary or 4 * n >= 3 * boundary or n < 2:
        entries = prefix_length(n)
        keys.append(ordered[:entries])
        places.append(np.arange(entries))
    if 2 <= n <= boundary:
        a, b = np.triu_indices(min(n, slack + 2), 1)
        keys.append(mix(ordered[a] * np.uint64(0x9E3779B97F4A7C15) + ordered[b]))
        places.append(np.full(len(a), -1))
    return np.concatenate(keys), np.concatenate(places)


def _ids_fit(ids: DataFrame) -> bool:
    return ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def join_texts(docs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of some documents: ``wanted`` is broadcast if it was counted to be small, else both are shuffled."""
    return docs.join(F.broadcast(wanted) if _ids_fit(wanted) else wanted.hint("shuffle_merge"), keys)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, chunk: int = 128) -> DataFrame:
    """The (a, b) of set ids that link, by exact intersection of whole texts' sets.

    Each text travels once for each leader ``a`` it is compared with; a leader's partners are cut into chunks.
    """
    pairs = written(pairs, "pairs")
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = skew_join(pairs, degree, "a", "n").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / chunk)).alias("chunk"))
    leaders = dealt.select(F.col("a").alias("sid"), F.col("a").alias("lead"), "chunk").distinct()
    members = dealt.select(F.col("b").alias("sid"), F.col("a").alias("lead"), "chunk").unionAll(leaders)
    wanted = written(members.join(reps, "sid").select("doc", "th", "sid", "lead", "chunk"), "wanted")
    texts = join_texts(docs.select("doc", "th", "text"), wanted, ["doc", "th"])

    def compare(batches: Iterable) -> Iterator[dict[str, list]]:
        lead, mine = None, np.zeros(0, np.uint64)
        for columns, texts in text_batches(batches):
            a, b = [], []
            for sid, own, text in zip(columns["sid"], columns["lead"], texts):
                if sid == own:
                    lead, mine = sid, shingle_set(text, size)
                elif own == lead:
                    other = shingle_set(text, size)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 7 * both >= 3 * (len(mine) + len(other)):
                        a.append(lead)
                        b.append(sid)
            yield {"a": a, "b": b}

    # Leaders come first in their runs, so a task holds one leader's set and streams the others past it.
    dealt = texts.repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", F.col("sid") != F.col("lead"))
    return map_arrow(dealt.select("sid", "lead", "text"), compare, "a long, b long")


def linked_groups(lists: DataFrame, bitmaps: DataFrame, verify: Callable[[DataFrame], DataFrame], spare_of: int) -> DataFrame:
    """(node, component) from lists of sets, rows (key, sid, n, place, last), their (sid, bits), and a ``verify`` of (a, b) pairs.

    ``n``: the set's size; ``place``: the key's position in the set's order, -1 where positions say
    nothing; ``last``: where the set's last placed key stands in the order of all keys. A set of n places n // ``spare_of`` keys more than it needs.
    """
    # Round one: each set against the leader that most of its lists have, if these are many. A list's leader is
    # the member most of whose keys are shared: in a group of near copies, what the others were made
    # from. A guess is enough here, since round two takes all that is left.
    shared = lists.groupBy("sid").agg((F.count("*") / F.max("n")).alias("score"))
    leaders = lists.select("key", "sid").join(shared, "sid").groupBy("key").agg(F.max(F.struct("score", "sid")).alias("t"), F.count("*").alias("m"))
    led = skew_join(lists.select("key", "sid", "n"), leaders.select("key", F.col("t.sid").alias("lead"), "m"), "key", "m")
    stars = led.where("sid <> lead").groupBy(F.col("lead").alias("a"), F.col("sid").alias("b")).agg(F.count("*").alias("k"), F.max("n").alias("n"))
    stars = stars.where(F.col("k") * 12 >= F.col("n")).groupBy("b").agg(F.max(F.struct("k", "a")).alias("t")).select("t.a", "b")
    first = written(verify(stars), "links")
    groups = written(components(first), "groups")

    # Round two: whatever shares a list but not a component.
    placed = lists.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    tally = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    major = tally.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("t"), F.count("*").alias("c"), F.sum("m").alias("held"))
    major = written(major.where("c > 1").select("key", F.col("t.comp").alias("major"), "held"), "major")
    # What two sets share before a common key is in mixed lists of both: ``before`` counts these. What they share after
    # it is in mixed lists too (``after``, with all beyond the prefix) for the set whose prefix ends first; the other's
    # prefix goes on beyond its partner's, where a shared shingle is in no list of both: its positions alone bound it.
    mixed = skew_join(placed, major, "key", "held")
    own, entries = Window.partitionBy("sid", F.col("place") < 0), F.col("n") - F.ceil(F.col("n") * 0.75) + 1 + F.floor(F.col("n") / spare_of)
    mixed = mixed.withColumns({"before": F.row_number().over(own.orderBy("place")) - 1, "prior": F.when(F.col("place") >= 0, F.lag("key").over(own.orderBy("place"))), "__open": F.count("*").over(own) + F.col("n") - entries})
    mixed = written(mixed.withColumn("after", F.col("__open") - F.col("before") - 1).drop("__open"), "mixed")
    long = mixed.where(F.col("held") >= LONG_LIST).join(bitmaps, "sid", "left")
    mixed = written(mixed.where(F.col("held") < LONG_LIST).withColumn("bits", F.lit(None).cast("array<long>")).unionByName(long), "mixed")
    columns = ("sid", "n", "place", "last", "comp", "before", "after", "prior", "bits")
    minor = mixed.where("comp <> major").select("key", "held", *[F.col(c).alias(f"{c}_a") for c in columns])
    every = mixed.select("key", "major", *[F.col(c).alias(f"{c}_b") for c in columns])
    rest_a = F.when(F.col("last_a") <= F.col("last_b"), F.col("after_a")).otherwise(F.col("n_a") - 1 - F.col("place_a"))
    rest_b = F.when(F.col("last_b") <= F.col("last_a"), F.col("after_b")).otherwise(F.col("n_b") - 1 - F.col("place_b"))
    reach = F.least("before_a", "before_b") + 1 + F.least(rest_a, rest_b)
    fits = (F.col("n_a") * 4 >= F.col("n_b") * 3) & (F.col("n_b") * 4 >= F.col("n_a") * 3)
    fits &= (F.col("place_a") < 0) | (F.col("place_b") < 0) | (reach * 7 >= (F.col("n_a") + F.col("n_b")) * 3)
    most_shared = F.least(F.col("n_a") - beyond(F.col("bits_a"), F.col("bits_b")), F.col("n_b") - beyond(F.col("bits_b"), F.col("bits_a")))
    fits &= F.coalesce(F.size("bits_a") != F.size("bits_b"), F.lit(True)) | F.coalesce(most_shared * 7 >= (F.col("n_a") + F.col("n_b")) * 3, F.lit(True))
    # Two sets whose keys before this one are the same meet there as well: one meeting of such a row is enough.
    fits &= F.coalesce(F.col("prior_a") != F.col("prior_b"), F.lit(True))
    once = (F.col("comp_b") == F.col("major")) | (F.col("sid_a") < F.col("sid_b"))
    met = skew_join(every, minor, "key", "held").where((F.col("comp_a") != F.col("comp_b")) & fits & once)
    doubtful = met.select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b")).distinct()
    second = written(verify(doubtful), "links")
    return written(components(first.unionByName(second)), "groups")


def near_classes(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; links at Jaccard 0.75 or more."""
    named = classified(docs, size)
    component = F.when(F.col("home").isNotNull(), F.nullif("home.doc", F.lit(LAST_ID))).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def classified(docs: DataFrame, size: int, heavy_from: int = 16, most_frequent: int = 200_000) -> DataFrame:
    """(doc_id, doc, th, n, home) of every row: the set's size, and (doc, th) of its group's first row, null without shingles."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("th"))
    seen = written(frequent_shingles(docs, size), "frequent")
    least = max(heavy_from, frequent_threshold(seen, most_frequent))
    common = seen.where(F.col("n") >= least).toArrow()  # at most most_frequent rows
    tokens = common["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    tokens, ranks = tokens[order], np.clip(np.log2(common["n"].to_numpy()[order] + 1) * 2, 1, 62).astype(np.uint64)
    below = seen.where(F.col("n") < least).agg(F.avg("n").alias("l")).first()["l"] or 1.0
    facts = spark.sparkContext.broadcast((tokens, ranks, light_boundary(float(below))))

    def run(batches: Iterable) -> Iterator[dict[str, list]]:
        tokens, ranks, boundary = facts.value
        known: set[int] = set()
        for columns, texts in text_batches(batches):
            out: dict[str, list] = {"n": [], "sid": [], "keys": [], "places": [], "last": [], "bits": []}
            for t in texts:
                s = shingle_set(t, size)
                sid, keys, places, last, bits = None, None, None, None, None
                if len(s):
                    sid = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                    if sid not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known.add(sid)
                        rank = np.zeros(len(s), np.uint64)
                        if len(tokens):
                            at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                            rank = np.where(tokens[at] == s, ranks[at], rank)
                        order = np.argsort(rank, kind="stable")
                        keys, places = signature(s[order], boundary)
                        end = order[prefix_length(len(s)) - 1]
                        last = int(rank[end]) << 57 | int(s[end]) >> 7
                        keys, bits = keys.view(np.int64), bitmap(s)
                out["n"].append(len(s))
                out["sid"].append(sid)
                out["keys"].append(keys)
                out["places"].append(places)
                out["last"].append(last)
                out["bits"].append(bits)
            yield columns | out

    sets = written(map_arrow(docs, run, "doc_id long, doc long, th long, n long, sid long, keys array<long>, places array<int>, last long, bits array<long>"), "sets")
    reps = sets.where("sid is not null").groupBy("sid").agg(F.min(F.struct("doc", "th")).alias("r"), F.count("*").alias("copies"))
    reps = written(reps.select("sid", "r.doc", "r.th", "copies"), "reps")
    entries = sets.where("keys is not null").select("sid", "n", "last", F.explode(F.arrays_zip("keys", "places")).alias("e"))
    entries = entries.select(F.col("e.keys").alias("key"), "sid", "last", (F.col("n") * (1 << 32) + F.col("e.places") + 1).alias("np"))
    shared = entries.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count("*").alias("m")).where("low <> high")
    lists = skew_join(entries, written(shared.select("key", "m"), "shared"), "key", "m")
    size_of, place = F.floor(F.col("np") / (1 << 32)).cast("long"), (F.col("np") % (1 << 32) - 1).cast("int")
    lists = written(lists.select("key", "sid", size_of.alias("n"), place.alias("place"), "last").distinct(), "lists")

    bitmaps = sets.where("bits is not null").groupBy("sid").agg(F.first("bits").alias("bits"))  # rows of one set are alike
    groups = linked_groups(lists, bitmaps, lambda pairs: verified(pairs, reps, docs, size), SPARE)
    named = reps.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    first = named.groupBy("component").agg(F.min(F.struct("doc", "th")).alias("home"))
    named = written(named.join(first, "component").select("sid", "copies", "home"), "named")
    linked = skew_join(sets.where("sid is not null").select("doc_id", "doc", "th", "n", "sid"), named, "sid", "copies")
    alone = sets.where("sid is null").select("doc_id", "doc", "th", "n", F.lit(None).cast("struct<doc: long, th: long>").alias("home"))
    return linked.select("doc_id", "doc", "th", "n", "home").unionByName(alone)


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that are their group's first by id (null ids last) and text hash; rows without shingles stay.

    Rows are told apart by id and text, so rows of one id but different texts stand for themselves. Repeated rows stay or go together.
    """
    own_doc, own_th = own_names(docs, "doc", "th")
    gone = classified(docs, size).where("home is not null and (doc <> home.doc or th <> home.th)").select(F.col("doc").alias(own_doc), F.col("th").alias(own_th))
    gone = written(gone.distinct(), "gone")
    keyed = docs.withColumns({own_doc: F.coalesce("doc_id", F.lit(LAST_ID)), own_th: F.xxhash64("text")})
    return keyed.join(F.broadcast(gone) if _ids_fit(gone) else gone, [own_doc, own_th], "left_anti").select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


#: DuckDB: all pairs of sets that share a shingle; components by closing the links.
OP5_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from words
), items as (select doc_id, len(s) as n, unnest(s) as x from sets
), links as (
  select a.doc_id as a, b.doc_id as b from items a join items b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(doc_id, r) as (
  select doc_id, doc_id from sets union select reach.doc_id, links.b from reach join links on links.a = reach.r
)
select s.doc_id, cast(any_value(len(s.s)) as bigint) as n_shingles, min(r.r) as component_id
from sets s join reach r on r.doc_id = s.doc_id group by s.doc_id
"""
