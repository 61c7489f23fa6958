"""Merkle dataset manifest (operator 13): an associative sparse-forest monoid.

Every row is a leaf, every group (language) a tree of ``arity``, and the trees' roots in order of group are the leaves of one
more tree, whose root stands for the dataset. Leaves are sorted over ranges, so a partition holds a stretch of
consecutive leaves and knows, from one row of counts for each partition, the tree, the index and the size of the tree of each.

A ``Forest`` is a set of nodes keyed by tree, level and index. Adding a node whose run of siblings is complete (the
size of the tree tells how many belong to it) replaces the run by its parent, and so on upwards. Forests merge by adding the
nodes of one to the other, in any order and grouping: that is the monoid. A partition folds to the few nodes along
its two ends; these are reduced in a tree of ``FAN_IN`` neighbours at a time, each round a table in the shared folder, so
neither a task nor the driver ever holds more than the ends of FAN_IN stretches. Siblings that a partition needs from outside
are asked for by run and joined with the nodes that any round has made.

Nulls: a null field is "-" in the leaf; a null group is a group of its own, the first; a null id comes first in its group
and counts as the empty text where its checksum is asked for. Empty texts are "0:". Rows of one id and group are in order of
their digests; repeated rows are neighbours and each has its own place. An empty table has no rows and no root. Columns besides the
named ones are ignored. Very long texts are hashed where they are read and go no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.frames import crc_mod, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: Neighbouring stretches that one task of a round merges.
FAN_IN = 64
#: The tree whose leaves are the roots of all others.
TOP = -1
OPEN, MADE, ASKED = 0, 1, 2
NODES = "part long, kind int, tree long, size long, level int, index long, digest string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: Sequence[str] = FIELDS, **instead: Column) -> Column:
    """The digest of a row: each field as byte count, ":" and value, "-" for null. ``instead`` replaces fields by expressions."""
    def item(name: str) -> Column:
        text = instead.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[item(f) for f in fields]), 256)


def widths(size: int, arity: int = ARITY) -> list[int]:
    """Nodes on each level of a tree of ``size`` leaves, from the leaves to the root."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class Forest:
    """Nodes whose run of siblings isn't complete yet. ``keep``: all nodes ever added or made stay known in ``known``."""

    def __init__(self, trees: int, arity: int = ARITY, keep: bool = False):
        self.trees, self.arity, self.keep = trees, arity, keep
        self.runs: dict[tuple[int, int, int], dict[int, str]] = {}
        self.sizes: dict[int, list[int]] = {TOP: widths(trees, arity)}
        self.made: list[tuple[int, int, int, int, str]] = []
        self.known: dict[tuple[int, int, int], str] = {}

    def add(self, tree: int, size: int, level: int, index: int, digest: str) -> None:
        new = False
        while True:
            if tree not in self.sizes:
                self.sizes[tree] = widths(size, self.arity)
            if self.keep:
                self.known[tree, level, index] = digest
            elif new:
                self.made.append((tree, size, level, index, digest))
            width = self.sizes[tree][level]
            if width == 1 and tree == TOP:
                return
            if width == 1:
                tree, size, level, index = TOP, self.trees, 0, tree
                new = True
                continue
            at, place = divmod(index, self.arity)
            run = self.runs.setdefault((tree, level, at), {})
            run[place] = digest
            if len(run) < min(self.arity, width - at * self.arity):
                return
            del self.runs[tree, level, at]
            digest, level, index, new = digest_of([run[k] for k in sorted(run)]), level + 1, at, True

    def open(self) -> Iterator[tuple[int, int, int, int, str]]:
        for (tree, level, at), run in self.runs.items():
            for place, digest in run.items():
                yield tree, self.sizes[tree][0], level, at * self.arity + place, digest

    def asks(self) -> set[tuple[int, int, int]]:
        """Runs (tree, level, run) that the paths from the open nodes to the root go through."""
        out: set[tuple[int, int, int]] = set()
        for tree, level, at in self.runs:
            while (tree, level, at) not in out:
                out.add((tree, level, at))
                level, index = level + 1, at
                if self.sizes[tree][level] == 1:
                    if tree == TOP:
                        out.add((TOP, level, 0))  # the root itself
                        break
                    tree, level, index = TOP, 0, tree
                    if self.sizes[TOP][0] == 1:
                        out.add((TOP, 0, 0))
                        break
                at = index // self.arity
        return out


class Paths:
    """Sibling runs from a leaf to the root; what leaves have in common is put together once for each stretch of them."""

    def __init__(self, known: dict[tuple[int, int, int], str], sizes: dict[int, list[int]], trees: int, arity: int = ARITY):
        self.known, self.sizes, self.arity = known, sizes, arity
        self.last: dict[tuple[int, int], tuple[int, list[tuple[str, str]], str]] = {}
        self.root = known[TOP, len(widths(trees, arity)) - 1, 0]

    def above(self, tree: int, level: int, index: int) -> tuple[list[tuple[str, str]], str]:
        """(what stands left and right of the path on each level, all of it in one string) from a node up."""
        key = (tree, level) if tree == TOP else (0, level)
        found = self.last.get(key)
        if found and found[0] == (tree, index):
            return found[1], found[2]
        width = self.sizes[tree][level]
        if width == 1 and tree == TOP:
            return [], ""
        if width == 1:
            return self.above(TOP, 0, tree)
        low = index - index % self.arity
        left = "".join([self.known[tree, level, k] for k in range(low, index)])
        right = "".join([self.known[tree, level, k] for k in range(index + 1, min(low + self.arity, width))])
        pairs, text = self.above(tree, level + 1, index // self.arity)
        made = [(left, right), *pairs], left + right + text
        if level or tree == TOP:
            self.last[key] = ((tree, index), *made)
        return made


def fold(digest: str, pairs: list[tuple[str, str]]) -> str:
    for left, right in pairs:
        digest = digest_of([left, digest, right])
    return digest


def _stretch(rows: pa.Table) -> tuple[list[tuple[int, int, int]], pa.Table]:
    """(tree, size of the tree, index) of the leaves of one partition, and its rows in order."""
    rows = rows.sort_by("pos")
    groups = list(zip(rows.column("named").to_pylist(), rows.column("group").to_pylist()))
    rank, before, first, last = (rows.column(c)[0].as_py() for c in ("rank", "before", "first_size", "last_size"))
    starts = [k for k in range(len(groups)) if k == 0 or groups[k] != groups[k - 1]] + [len(groups)]
    out = []
    for t, (low, high) in enumerate(zip(starts, starts[1:])):
        size = first if t == 0 else last if high == len(groups) else high - low
        skip = before if t == 0 else 0
        out += [(rank + t, size, skip + k) for k in range(high - low)]
    return out, rows


def _nodes(part: int, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    names = ["part", "kind", "tree", "size", "level", "index", "digest"]
    return pa.table([pa.array([part] * len(rows), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)


def ranges(leaves: DataFrame, rows_per_part: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The leaves in sorted stretches (part, pos), the place of each stretch in the forest, and the numbers of trees and stretches."""
    spark = leaves.sparkSession
    n = leaves.count()
    parts = max(1, -(-n // rows_per_part))
    named = leaves.withColumns({"named": F.col("group").isNotNull(), "group": F.coalesce("group", F.lit("")), "__row": F.monotonically_increasing_id()})
    order = ["named", "group", F.col("id").asc_nulls_first(), "leaf", "__row"]  # the last one parts repeated rows, which are alike
    dealt = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumns({"part": F.spark_partition_id().cast("long"), "pos": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    dealt = written(dealt.select("part", "pos", "named", "group", "id", "leaf", "claimed"), "leaves")
    key = F.struct("named", "group")
    counted = dealt.groupBy("part", "named", "group").agg(F.count("*").alias("n")).groupBy("part")
    ends = counted.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.min_by("n", key).alias("n_low"), F.max_by("n", key).alias("n_high"), F.count("*").alias("trees"))
    found = sorted(ends.collect(), key=lambda r: r.part)  # one row for each partition
    rank, total = -1, {}
    ranks = []
    before = []
    for k, r in enumerate(found):
        same = k > 0 and found[k - 1].high == r.low
        rank += 0 if same else 1
        ranks.append(rank)
        before.append(total.get(rank, 0))
        total[rank] = total.get(rank, 0) + r.n_low
        if r.trees > 1:
            rank += r.trees - 1
            total[rank] = r.n_high
    places = [(r.part, a, b, total[a], total[a + r.trees - 1]) for r, a, b in zip(found, ranks, before)]
    frame = spark.createDataFrame(places, "part long, rank long, before long, first_size long, last_size long")
    return dealt.join(F.broadcast(frame), "part"), frame, rank + 1, len(found)


def prove(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", claimed: Column | None = None, rows_per_part: int = 100_000, siblings: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; with ``siblings`` also the digests that
    make the proof, from the leaf up. ``claimed`` is the digest of the row as somebody shows it (by default the row's
    own): folded_root is what it and the proof make, and verified whether that is the root."""
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(group).cast("string").alias("group"), F.col(key).alias("id"), leaf(fields).alias("leaf"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    leaves, places, trees, parts = ranges(written(own, "digests"), rows_per_part)
    given = "part", "pos", "named", "group", "leaf", "rank", "before", "first_size", "last_size"

    def fold_part(rows: pa.Table) -> pa.Table:
        at, rows = _stretch(rows)
        forest = Forest(trees)
        for (tree, size, index), digest in zip(at, rows.column("leaf").to_pylist()):
            forest.add(tree, size, 0, index, digest)
        open_nodes = [(OPEN, *x) for x in forest.open()]
        return _nodes(rows.column("part")[0].as_py(), open_nodes + [(ASKED, tree, 0, level, run, "") for tree, level, run in forest.asks()])

    nodes = written(leaves.select(*given).groupBy("part").applyInArrow(fold_part, NODES), "forest")
    asked, rounds, width = nodes.where(F.col("kind") == ASKED), [nodes.where(F.col("kind") == OPEN)], parts

    def merge(rows: pa.Table) -> pa.Table:
        forest = Forest(trees)
        for tree, size, level, index, digest in zip(*[rows.column(c).to_pylist() for c in ("tree", "size", "level", "index", "digest")]):
            forest.add(tree, size, level, index, digest)
        left = list(forest.open())
        closed = set(forest.made).difference(left)
        return _nodes(rows.column("part")[0].as_py(), [(OPEN, *x) for x in left] + [(MADE, *x) for x in closed])

    while width > 1:
        last = rounds[-1].where(F.col("kind") == OPEN).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        rounds.append(written(last.groupBy("part").applyInArrow(merge, NODES), "forest"))
        width = -(-width // FAN_IN)
    spine = rounds[0]
    for r in rounds[1:]:
        spine = spine.unionAll(r)
    spine = spine.select("tree", "level", "index", "digest").distinct()  # a node that stays open for some rounds is there once for each
    wanted = asked.select("part", "tree", "level", F.col("index").alias("run"))
    around = wanted.join(spine.withColumn("run", F.floor(F.col("index") / ARITY).cast("long")), ["tree", "level", "run"]).select("part", "tree", "level", "index", "digest")

    def prove_part(rows: pa.Table, context: pa.Table) -> pa.Table:
        at, rows = _stretch(rows)
        leaves = rows.column("leaf").to_pylist()
        forest = Forest(trees, keep=True)
        for (tree, size, index), digest in zip(at, leaves):
            forest.add(tree, size, 0, index, digest)
        known = forest.known
        for tree, level, index, digest in zip(*[context.column(c).to_pylist() for c in ("tree", "level", "index", "digest")]):
            known[tree, level, index] = digest
        paths = Paths(known, forest.sizes, trees)
        out: list[tuple] = []
        for (tree, _, index), digest, shown in zip(at, leaves, rows.column("claimed").to_pylist()):
            pairs, text = paths.above(tree, 0, index)
            folded = fold(shown or digest, pairs)
            row = (known[TOP, 0, tree], paths.root, digest_of([text]), folded, folded == paths.root)
            out.append((*row, [text[k : k + 64] for k in range(0, len(text), 64)]) if siblings else row)
        columns = list(zip(*out))
        names = ["subroot", "root", "proof_sha256", "folded_root", "verified", *["siblings"] * siblings]
        kinds = [*[pa.string()] * 4, pa.bool_(), *[pa.list_(pa.string())] * siblings]
        made = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.table([rows.column("id"), rows.column("leaf"), *made], names=[key, "leaf", *names])

    schema = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", siblings array<string>" * siblings
    return leaves.groupBy("part").cogroup(around.groupBy("part")).applyInArrow(prove_part, schema)


def root_of(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id") -> str | None:
    """The dataset's root digest; None for an empty table."""
    found = prove(docs, fields, group, key).select("root").first()
    return found.root if found else None


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod("doc_id", 3) == 0, leaf(text=F.translate("text", _UPPER, _LOWER)))
    return prove(docs, claimed=tampered)


#: The checksum bit by bit, levels as a recursion, siblings by a join of all nodes.
OP13_SQL = """
with recursive fields as (
  select doc_id, lang, source, n_chars, text, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda s, k: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end)) as crc
  from documents),
spelt as (
  select doc_id, lang, crc,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') as low
  from fields),
leaves as (
  select doc_id, lang, sha256(head || tail) as leaf, sha256(head || case when (4294967295 - crc) % 3 = 0 then low else tail end) as shown,
    dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, sha256(head || tail)) - 1 as idx
  from spelt),
nodes as (
  select tree, 0 as lvl, idx, leaf as h, count(*) over (partition by tree) as n from leaves
  union all
  select tree, lvl + 1, idx // 8, sha256(string_agg(h, '' order by idx)), (any_value(n) + 7) // 8 from nodes where n > 1 group by tree, lvl, idx // 8),
subs as (select tree, h, lvl from nodes where n = 1),
tops as (
  select 0 as lvl, tree as idx, h, count(*) over () as n from subs
  union all
  select lvl + 1, idx // 8, sha256(string_agg(h, '' order by idx)), (any_value(n) + 7) // 8 from tops where n > 1 group by lvl, idx // 8),
every as (select tree, lvl, idx, h from nodes where n > 1 union all select -1, lvl, idx, h from tops where n > 1),
steps as (
  select row_number() over () as r, doc_id, leaf, shown, tree, idx from leaves),
sides as (
  select s.r, e.lvl + case when e.tree = -1 then 100 else 0 end as height, string_agg(e.h, '' order by e.idx) filter (e.idx < p.own) as l, string_agg(e.h, '' order by e.idx) filter (e.idx > p.own) as g
  from steps s, unnest([{'t': s.tree, 'i': s.idx}, {'t': -1, 'i': s.tree}]) w(x), every e, unnest([(w.x.i // (8 ** e.lvl)::bigint)]) p(own)
  where e.tree = w.x.t and e.idx // 8 = p.own // 8 group by s.r, e.tree, e.lvl),
listed as (
  select r, coalesce(string_agg(coalesce(l, '') || coalesce(g, ''), '' order by height), '') as proof, coalesce(list({'l': coalesce(l, ''), 'g': coalesce(g, '')} order by height), []) as path from sides group by r),
folds as (
  select s.r, 1 as k, s.shown as h, coalesce(p.path, []) as path from steps s left join listed p on p.r = s.r
  union all
  select r, k + 1, sha256(path[k].l || h || path[k].g), path from folds where k <= len(path))
select s.doc_id, s.leaf, b.h as subroot, t.h as root, sha256(coalesce(p.proof, '')) as proof_sha256, f.h as folded_root, f.h = t.h as verified
from steps s join subs b on b.tree = s.tree join (select h from tops where n = 1) t on true left join listed p on p.r = s.r join folds f on f.r = s.r and f.k = len(f.path) + 1
"""
