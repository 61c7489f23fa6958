import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rastrum.llm.merkle import OPEN, TOP, Forest, fold, leaf, prove, root_of, widths

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part string, pos string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spelt(row, text=None):
    values = [row[0], row[1], row[2], row[3], row[4] if text is None else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof) of every row, in plain Python."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), spelt(r), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for t, g in enumerate(order):
        for i, (_, digest, doc) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            proof, at = [], i
            for level in trees[g][:-1]:
                proof += [x for k, x in enumerate(level) if k // 8 == at // 8 and k != at]
                at //= 8
            at = t
            for level in top[:-1]:
                proof += [x for k, x in enumerate(level) if k // 8 == at // 8 and k != at]
                at //= 8
            out.append((doc, digest, trees[g][-1][0], top[-1][0], sha("".join(proof)), proof))
    return out


def rows(n, langs, seed=1):
    rng = random.Random(seed)
    made = [(k, rng.choice(["a", None]), f"l{rng.randrange(langs)}" if rng.random() > 0.3 else "l0", k, "Wörter " * rng.randrange(4), "p", "q") for k in range(n)]
    return [*made, (None, None, None, None, None, "p", "q"), (None, "x", None, 0, "", "p", "q"), (5, "a", "l0", 1, "Other text", "p", "q"), (7, "s", "l0", 2, "Twice", "p", "q"), (7, "s", "l0", 2, "Twice", "p", "q"), (8, "", "", 0, "é" * 50_000, "p", "q")]


@pytest.mark.parametrize("n, langs, per_part", [(40, 1, 1000), (700, 3, 5), (300, 90, 40), (600, 600, 7)])
def test_proofs(spark, n, langs, per_part):
    given = rows(n, langs)
    random.Random(2).shuffle(given)
    docs = spark.createDataFrame(given, SCHEMA)
    got = prove(docs, rows_per_part=per_part, siblings=True).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[4])
    have = sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.siblings) for r in got], key=key)
    assert have == sorted(brute(given), key=key) and all(r.verified and r.folded_root == r.root for r in got)


def test_tampered_rows_fail(spark):
    given = rows(90, 4)
    docs = spark.createDataFrame(given, SCHEMA)
    shown = leaf(text=F.translate("text", "OTW", "otw"))
    for r in prove(docs, claimed=shown, rows_per_part=20).join(docs.select("doc_id", "text"), "doc_id").where("doc_id not in (5, 7, 8)").collect():
        assert r.verified == (r.text is None or not set(r.text) & set("OTW")) and (r.folded_root == r.root) == r.verified


def test_few_rows(spark):
    docs = spark.createDataFrame([(1, "s", "en", 3, "abc", "p", "q")], SCHEMA)
    only = prove(docs).collect()[0]
    assert only.leaf == only.subroot == only.root == only.folded_root == spelt((1, "s", "en", 3, "abc")) and only.proof_sha256 == sha("") and only.verified
    none = spark.createDataFrame([], SCHEMA)
    assert prove(none).count() == 0 and prove(none).columns == prove(docs).columns and root_of(none) is None
    assert root_of(docs) != root_of(docs.withColumn("text", F.lit("abd"))) and widths(65) == [65, 9, 2, 1] and zlib.crc32(b"") % 3 == 0


def test_forest_is_a_monoid():
    """Any way to deal nodes and merge the parts leaves the same nodes."""
    rng, sizes = random.Random(3), [70, 1, 9, 513]
    nodes = [(t, n, 0, i, sha(f"{t} {i}")) for t, n in enumerate(sizes) for i in range(n)]
    for gone in ((), nodes[:1], nodes[75:78] + nodes[300:302]):
        left = [x for x in nodes if x not in gone]
        results = []
        for parts in (1, 2, 13):
            rng.shuffle(left)
            forests = []
            for k in range(parts):
                forests.append(Forest(len(sizes)))
                for x in left[k::parts]:
                    forests[-1].add(*x)
            rng.shuffle(forests)
            whole = Forest(len(sizes))
            for f in forests:
                for x in f.open():
                    whole.add(*x)
                for x in f.made:
                    if x[0] == TOP and x[2] == len(widths(len(sizes))) - 1:
                        whole.add(*x)
            results.append((sorted(whole.open()), {x for f in [*forests, whole] for x in f.made}))
        assert all(r == results[0] for r in results) and bool(results[0][0]) == bool(gone) and OPEN == 0
    assert fold("a", [("b", "c"), ("", "")]) == sha(sha("bac"))
