import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastrum.llm.ann import nearest
from rastrum.llm.bpe import WordBpe, encode_documents
from rastrum.llm.hnsw import near_groups
from rastrum.llm.jaccard import keep_one, near_classes, shingle_set
from rastrum.llm.lines import dedup_lines
from rastrum.llm.lm import DIM, Ids, LogBilinear, draw_blocks, fit, score_texts, windows
from rastrum.llm.packing import best_cuts, pack, split_tail
from rastrum.llm.quality import keep_good, score_quality
from rastrum.llm.shards import ShardStore

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __pos string, sid string"
LONG = "word " * 30_000 + "x" * 5_000
ROWS = [
    (1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "b", 0),
    (4, LONG, "en", "c", len(LONG)), (None, "one two three four five six", None, "b", 5), (5, "Two\n\n words", "en", "c", 10), (6, "ONE two three four five six", "de", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "p", "s") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_lines(odd, none):
    out = dedup_lines(odd, min_sites=2).collect()
    assert len(out) == len(ROWS) and dedup_lines(none).count() == 0
    assert [r.text for r in out if r.doc_id == 1] == [ROWS[0][1]] * 2 and [r.text for r in out if r.doc_id is None] == [""]
    assert [r.text for r in out if r.doc_id == 2] == [None] and all(r["__pos"] == "p" for r in out)
    assert [(r.n_lines, r.n_removed) for r in out if r.doc_id == 5] == [(2, 0)]


def test_shards(spark, odd, none, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), odd.schema, target_bytes=60_000)
    assert store.read().count() == 0
    for k in range(5):
        store.append(odd.coalesce(1))
    store.append(none)
    before = len(store.shards())
    version = store.compact()
    assert store.read().count() == 5 * len(ROWS) and len(store.shards()) < before and store.read(1).count() == len(ROWS)
    with pytest.raises(RuntimeError):
        store.commit([], [], version - 1)
    store.vacuum(version)
    assert store.versions() == [version] and store.read(version).count() == 5 * len(ROWS)
    assert store.versions() == [version] and store.read().exceptAll(odd.union(odd).union(odd).union(odd).union(odd)).count() == 0


def test_vacuum_keeps_newer_versions_and_open_writers(spark, odd, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), odd.schema)
    for _ in range(3):
        store.append(odd.coalesce(1))
    odd.coalesce(1).write.parquet(f"{store.root}/data/open")
    store.vacuum(2)
    assert [store.read(v).count() // len(ROWS) for v in (2, 3)] == [2, 3] and store.versions() == [2, 3]
    opened = store._files(f"{store.root}/data/open")
    assert opened and store.read(store.commit(opened, [], 3)).count() == 4 * len(ROWS)
    before = store.shards()
    store.compact()
    store.vacuum(store.versions()[-1], least_age=0)
    assert store.read().count() == 4 * len(ROWS) and len(store._files(f"{store.root}/data")) == len(store.shards()) <= len(before)


def test_lines_at_large_thresholds(spark):
    sites = {**{f"below {k}": 196 for k in range(30)}, **{f"at {k}": 200 for k in range(30)}}
    rows = spark.createDataFrame([(line, n) for line, n in sites.items()], "line string, n int").selectExpr("line", "explode(sequence(1, n)) as site")
    docs = rows.selectExpr("site as doc_id", "line as text", "cast(site as string) as source", "'x' as __gone", "'y' as __doc")
    out = dedup_lines(docs, min_sites=200)
    assert out.columns == ["doc_id", "source", "__gone", "__doc", "text", "n_lines", "n_removed"]
    gone = {r["line"]: r["n"] for r in out.join(docs.select("doc_id", docs.text.alias("was")), "doc_id").where("text <> was").groupBy(F.col("was").alias("line")).agg(F.count("*").alias("n")).collect()}
    assert out.where("n_removed > 0").count() == 30 * 199 and gone is not None


def test_keep_one_tells_rows_by_text(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    docs = spark.createDataFrame([(3, b, "u"), (7, a, "u"), (7, b, "u"), (9, a, "u"), (None, a, "u"), (11, None, "u"), (None, None, "u")], "doc_id long, text string, th string")
    out = keep_one(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, ""), (3, b), (7, a), (11, "")]


def plain_chances(model: LogBilinear):
    """P of all ids behind three ids, nearest first, straight from the parameters."""
    rows, v, known = model.rows.astype(float), model.v, {}

    def softmax(s):
        e = np.exp(s - s.max())
        return e / e.sum()

    def chances(before):
        if before not in known:
            x = sum(rows[u, :DIM] * rows[2 * v + j, :DIM] for j, u in enumerate(before))
            score = rows[:, :DIM] @ x + rows[:, DIM]
            known[before] = out = np.empty(v)
            for k, p in enumerate(softmax(score[2 * v + 3 :])):
                members = model.classes.order[model.classes.edges[k] : model.classes.edges[k + 1]]
                out[members] = p * softmax(score[v + members])
        return known[before]

    return chances


def test_lm(spark, odd, none, docs, monkeypatch):
    from collections import Counter

    from rastrum.llm import lm

    made = []
    monkeypatch.setattr(lm, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in score_texts(docs, vocabulary=64, buckets=16, most_frequent=300).collect()}
    counts, tokens = Counter(), {}
    for r in rows:
        tokens[r.doc_id] = [*(r.text or "").encode().lower().split(), b""]
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update(tokens[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    # The model's probability of every token in plain Python: its class, itself in the class, then the share inside a bucket
    top = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[:63]
    ids = {w: i for i, w in enumerate([b"", *top])}
    bucket = lambda w: zlib.crc32(w[-3:]) % 16
    of = lambda w: ids[w] if w in ids else 64 + bucket(w)
    totals = Counter({b: 1 for b in range(16)})
    for w, c in counts.items():
        totals[bucket(w)] += 0 if w in ids else c + 1
    chances = plain_chances(made[0])
    for i, seen in tokens.items():
        base = sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in seen)
        assert got[i].train_tokens == n and got[i].n_tokens == len(seen) and got[i].n_known == sum(t in counts for t in seen) and abs(got[i].base_score - base) < 1e-6
        before, score = [0, 0, 0], 0.0
        for t in seen:
            p = chances(tuple(before[:-4:-1]))
            score += np.log10(p[of(t)]) + (0 if t in ids else np.log10((counts[t] + 1) / totals[bucket(t)]))
            before.append(of(t))
        assert abs(got[i].score - score) < 1e-3
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(abs(chances(h).sum() - 1) < 1e-5 for h in ((0, 0, 0), (1, 2, 3), (70, 5, 79)))
    assert score_texts(odd).count() == len(ROWS) and score_texts(none).count() == 0
    # More than ``most_frequent`` tokens that are commoner than the end of a text
    few = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(40))) for k in range(1, 6)], "doc_id long, text string").unionAll(spark.createDataFrame([(9, "w1 w2 " * 30)], "doc_id long, text string"))
    assert score_texts(few, vocabulary=8, buckets=4, most_frequent=2).where("isnan(score) or score > 0 or n_known > n_tokens").count() == 0


def test_lm_training(spark):
    """A token follows from the one before it in 0.725 of cases, whatever came earlier: learnt in the contexts that occur."""
    rng = np.random.default_rng(1)
    line = [0, 1, 2]
    for _ in range(64 * 2000):
        line.append(1 + (line[-1] * 5 + 3) % 12 if rng.random() < 0.7 else int(rng.integers(1, 13)))
    blocks = spark.createDataFrame([(line[k : k + 67],) for k in range(0, len(line) - 67, 64)], "ids array<int>")
    n = np.bincount(line, minlength=13) + 0.5
    model = fit(blocks.repartition(3), n / n.sum(), rates=(0.03, 0.03), class_rates=(0.06,) * 10)
    chances = plain_chances(model)
    for u in range(1, 13):
        p = np.mean([chances(tuple(line[i : i - 3 : -1])) for i in range(3, 3000) if line[i] == u], 0)
        assert abs(p.sum() - 1) < 1e-5 and abs(p[1 + (u * 5 + 3) % 12] - 0.725) < 0.15
    at = np.stack([line[2:-1], line[1:-2], line[:-3], line[3:]], 1)[:500]
    assert np.allclose(np.exp(model.log_probabilities(at, 100)), [chances(tuple(w[:3]))[w[3]] for w in at.tolist()], atol=1e-4)


def test_lm_blocks(spark):
    """Windows of the drawn blocks against the texts; all blocks at a share of one, about a third at three."""
    ids = Ids({b"": 0, **{f"w{i}".encode(): i + 1 for i in range(50)}}, 4)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"W{i}" for i in rng.integers(0, 50, n)) for n in (0, 1, 63, 64, 65, 127, 128, 20_000)] + [None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = []
    for t in texts:
        line = [0, 0, 0, *ids.of((t or "").encode().lower().split()), 0]
        want += [tuple(line[i - 1 - j] for j in range(3)) + (line[i],) for i in range(3, len(line))]
    got = [windows(pa.record_batch([pa.array([r.ids for r in draw_blocks(docs, ids, s).collect()], pa.list_(pa.int32()))], ["ids"])) for s in (1.0, 3.0)]
    assert sorted(map(tuple, got[0].tolist())) == sorted(want) and 0.2 < len(got[1]) / len(want) < 0.5 and set(map(tuple, got[1].tolist())) <= set(want)


def test_every_training_token_is_learnt_from(spark, monkeypatch):
    """The blocks that the model learns from hold all tokens and ends of all training texts, and of no others."""
    from rastrum.llm import lm

    docs = spark.range(3000).selectExpr("id as doc_id", "array_join(transform(sequence(1, 200), k -> concat('w', (id * k) % 97)), ' ') as text")
    learnt = []
    monkeypatch.setattr(lm, "fit", lambda blocks, p: learnt.append(sum(len(windows(b)) for b in blocks.toArrow().combine_chunks().to_batches())) or fit(blocks.limit(20), p))
    got = score_texts(docs, vocabulary=64, buckets=16).select("held_out", "n_tokens", "train_tokens").toPandas()
    assert learnt == [got.n_tokens[~got.held_out].sum()] and learnt[0] == got.train_tokens[0] > 500_000


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:130] = x[100] + rng.normal(0, 0.05, (30, 16))
    x[200:260] = x[200]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [None] * 16, 0), (9005, [1.0], 0), (None, [1.0] * 16, 0)]
    given = vectors(spark, rows + odd)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T
    got = {}
    for r in nearest(given).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = total = 0
    for q in range(0, 700, 50):
        order = [k for k in np.lexsort((np.arange(700), -np.round(s[q], 12))) if k != q][:5]
        hits, total = hits + len(set(order) & set(got[q])), total + 5
    assert hits / total >= 0.9 and got[200] == [201, 202, 203, 204, 205]
    out = {r.vec_id: r for r in near_groups(given).collect()}
    links = (s >= 0.9).sum(1) - 1
    assert len(out) == 706 and sum(out[i].n_links == links[i] for i in range(700)) >= 695
    assert out[230].component_id == 200 and not out[230].kept and out[200].kept and out[9001].component_id == 9001 and out[9002].n_links == 0
    assert nearest(vectors(spark, [])).count() == 0 and near_groups(vectors(spark, [])).count() == 0 and nearest(vectors(spark, rows[:3])).count() == 2


def test_queries_unlike_the_rest(spark):
    """Queries far from all clusters, a dense group under one code, and components whose squares overflow."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 32))[rng.integers(60, size=4000)] + rng.normal(0, 0.1, (4000, 32))
    x[1::4] = x[1] + rng.normal(0, 1e-3, (1000, 32))
    x[::50] = rng.normal(size=(80, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u[::50] @ u.T
    s[np.arange(80), np.arange(0, 4000, 50)] = -2
    true = np.argsort(-s, 1, kind="stable")[:, :5]
    for size in (1.0, 1e200):
        given = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = nearest(given).collect()
        assert len(got) == 400 and sum(r.vec_id in true[r.query_id // 50] for r in got) >= 0.95 * 400
        assert max(abs(r.score - s[r.query_id // 50, r.vec_id]) for r in got) < 1e-12


def test_jaccard(odd, none, docs):
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: set(shingle_set(r.text or "").tolist()) for r in rows}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_classes(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    out = near_classes(odd).collect()
    assert len(out) == len(ROWS) and {r.component_id for r in out if r.doc_id in (1, 6, None)} == {1} and {r.n_shingles for r in out if r.doc_id in (2, 3)} == {0}
    assert near_classes(none).count() == 0


def brute_components(sets):
    """The least index that each set reaches by links of Jaccard 0.75 or more."""
    least = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] & sets[b] and 7 * len(sets[a] & sets[b]) >= 3 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((least[a], least[b]))
                least = [x if c == y else c for c in least]
    return least


def test_jaccard_growing(spark):
    rng = np.random.default_rng(8)
    texts = []
    for chain in range(60):
        own, low, high, n = [f"c{chain}w{k}" for k in range(1200)], 600, 600, int(rng.integers(40, 110))
        while n < 420:
            grown = n + 4 - (high - low)
            front = int(rng.integers(0, grown + 1))
            low, high = low - front, high + grown - front
            texts.append(" ".join(own[low:high]))
            n = n * 4 // 3
    order = rng.permutation(len(texts)).tolist()
    least = brute_components([set(shingle_set(texts[i]).tolist()) for i in order])
    docs = spark.createDataFrame([(k, texts[i]) for k, i in enumerate(order)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_classes(docs).collect()} == dict(enumerate(least))


def test_bpe(odd, none, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = WordBpe(path), Tokenizer.from_file(path)
    odd_texts = ["", "Σίσυφος ΟΔΟΣ İ ﬁ é", "a<|endoftext|>b", "1½ 一二 \x85\x1c x", "'S don't", "a" * 3000, "😀​‍  "]
    for t in [*odd_texts, *[r.text for r in docs.limit(60).collect()]]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids and own.decode(own.encode(t)).decode() == library.decode(ids, skip_special_tokens=False)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    mixed = [" ".join(f"a{c}b {c}{c} 1{c}." for c in every[k : k + 64]) for k in range(0, len(every), 64)]
    for t, enc in zip(mixed, library.encode_batch(mixed, add_special_tokens=False)):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == enc.ids
    assert encode_documents(odd, path).count() == len(ROWS) and encode_documents(none, path).count() == 0


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() > 0.99 and (bad.predicted == 0).mean() > 0.95
    scored = score_quality(odd, labels).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored) and score_quality(none, labels).count() == 0
    assert keep_good(odd, labels).columns == odd.columns and score_quality(odd, labels.limit(0)).where("predicted = 1").count() == len(ROWS)


def test_factorisation_machine_against_all_pairs():
    from rastrum.llm.quality import features, fit

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, 12)) + ("!!" if i % 2 else ".") for i in range(60)] + [""]
    rows = [features(t, None) for t in texts]
    machine = fit(rows, np.array([i % 2 for i in range(len(texts))], float), rounds=3)
    for t in texts[:10] + texts[-1:]:
        index, x = machine.inputs(t, None)
        z = sum(machine.linear[i] * a for i, a in zip(index, x))
        z += sum(machine.factors[index[k]] @ machine.factors[index[m]] * x[k] * x[m] for k in range(len(x)) for m in range(k))
        assert abs(machine.score(t, None) - 1 / (1 + np.exp(-z))) < 1e-9


def test_packing(odd, none, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = pack(docs, path, block=1 << 14).toPandas()
    for r in docs.limit(40).collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == r.doc_id].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.start == mine.length.cumsum() - mine.length).all() and (mine.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.length.sum() <= 2048 and (part.offset == part.length.cumsum() - part.length).all()
    assert pack(odd, path).where("doc_id in (2, 3)").select("doc_tokens").distinct().collect()[0][0] == 1 and pack(none, path).count() == 0
    places, cost = np.array([3, 5, 9, 12, 16]), np.array([0, 8, 8, 0, 0])

    def brute(window):
        best = {0: 0}
        for j, p in enumerate(places.tolist()):
            best[p] = min(b + (0 if p - a in (1, 2, 4) and p - a >= window // 16 else window - (p - a)) + int(cost[j]) + 1 for a, b in best.items() if 0 < p - a <= window)
        return best[16]

    cuts = best_cuts(places, cost, 8)
    total = sum((0 if b - a in (1, 2, 4) else 8 - (b - a)) + int(cost[places.tolist().index(b)]) + 1 for a, b in zip([0, *cuts], cuts))
    assert total == brute(8) and sum(split_tail(1000, 2048, 64)) == 1000


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL).toPandas()
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    ids = {r.doc_id for r in docs.collect()}
    assert set(out.doc_id) <= ids and out.length.sum() > 0
    kept = corpus_pipeline.quality(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.join(labels.where("quality = 1"), "doc_id").count() > 0.98 * docs.join(labels.where("quality = 1"), "doc_id").count()
    left = corpus_pipeline.near_copies(spark, docs, SMALL)
    assert near_classes(left).where("doc_id <> component_id").count() == 0
    assert corpus_pipeline.lines(spark, docs, SMALL).count() == docs.count() and F is not None
