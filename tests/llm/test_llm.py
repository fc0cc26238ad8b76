"""The training-data operators against brute force, on rows with nulls, empty and repeated texts, ties and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
from quillspark.llm import bpe, chunks, html_text, maxscore, near_dup, packing, queries, sharding, simple8b, substrings, toxicity, vptree  # noqa: E402
from quillspark.llm.common import new_path, split_words  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, row string, n_words int, shard int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = ["Alpha", "bêta", "gamma,", "δ", "x1", "don't", "<|endoftext|>", "日本", "a", "b."]
    base = [" ".join(rng.choice(words, 90)) for _ in range(6)]
    texts = [None, "", " ", "one", "one two", *base, base[0], base[0] + " more", base[1][:200] + " " + base[2], "\t tab\n\n two  spaces ", "a a " * 40, "z " * 3000]
    out = [(i, t, "en", "r", i, i) for i, t in enumerate(texts)]
    return [*out, out[5], (None, "no id", "en", "r", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_bpe(docs, empty, rows):
    t, encode = library(queries.BYTE_BPE)
    said = collections.Counter()
    for d, text, *_ in rows:
        ids = encode(text)
        said[(d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, bpe.round_trip_digests(docs, queries.BYTE_BPE).collect())) == said
    assert bpe.round_trip_digests(empty, queries.BYTE_BPE).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, queries.BYTE_BPE), queries.BYTE_BPE)
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((d, x or "") for d, x, *_ in rows)


def test_token_files(spark, docs, empty, rows):
    _, encode = library(queries.WORD_BPE)
    path = new_path(spark, "tokens")
    index = simple8b.write_token_files(docs, queries.WORD_BPE, path, ids_per_file=500)
    got = simple8b.read_token_files(index, path).orderBy("start").collect()
    start = 0
    for r, (d, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = [*encode(text), 1]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows) and simple8b.decode_token_files(index, path).count() == len(rows)
    assert simple8b.write_and_read(spark, empty, queries.WORD_BPE, new_path(spark, "none")).count() == 0


def test_simple8b_escapes():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2) >> rng.integers(0, 63, 5000).astype(np.uint64)
    f = simple8b.TokenFile(simple8b.file_bytes([1], np.array([5000]), values))
    assert len(f.escapes) and (f.ids(0, 5000) == values).all() and (f.ids(1500, 2000) == values[1500:3500]).all()


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) + (f" zork{rng.integers(9)} " if i % 4 == 0 else " ") + " ".join(rng.choice(words, 9)) for i in range(800)]
    labels = np.array([i % 4 == 0 for i in range(800)], dtype=np.int64)
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(labels)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(data, marks).where("held_out").collect()
    assert got and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    right = [r["predicted"] == labels[r["doc_id"]] for r in got]
    assert np.mean(right) > 0.95 and all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    odd = toxicity.classify(docs, marks.limit(0))
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.classify(empty, marks).count() == 0
    assert toxicity.clean_documents(docs, toxicity.train([], np.zeros(0, dtype=np.int64))).columns == docs.columns


def test_toxicity_cut_at_the_true_ratio(spark):
    """One document in twenty is toxic and the fitted sample is half toxic: a cut that is best in the sample is far too loose."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    toxic = np.arange(4000) % 20 == 0
    weak = toxic | (rng.random(4000) < 0.2)
    strong = toxic & (rng.random(4000) < 0.6)
    texts = [" ".join([*rng.choice(words, 12), *["zork"] * int(w), *rng.choice(words, 4), *["blag"] * int(s), *rng.choice(words, 4)]) for w, s in zip(weak, strong)]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(data, marks, toxicity.Settings(positives=150, negatives=150, examples=6000)).collect()
    said = np.zeros(4000, dtype=bool)
    said[[r["doc_id"] for r in got if r["predicted"]]] = True
    assert said[strong].mean() > 0.9 and said[~toxic].mean() < 0.03


def test_sample_is_bounded_in_rows(spark):
    data = spark.createDataFrame([(i % 40, f"text {i % 40} {i // 400}") for i in range(2000)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    ids, texts, truth = toxicity.labelled_sample(data, known, toxicity.Settings(positives=3, negatives=5))
    assert len(ids) == len(set(ids)) == len(texts) <= 8 and truth.sum() <= 3 and all(t == f"text {d} 0" for d, t in zip(ids, texts))


def test_training_leaves_the_driver_alone(spark, monkeypatch):
    """The model is fitted in an executor, and is the one that the same rows give in the driver."""
    import os

    driver, train = os.getpid(), toxicity.train

    def elsewhere(texts, labels, settings=None):
        assert os.getpid() != driver, "trained in the driver"
        return train(texts, labels, settings)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    data = spark.createDataFrame([(i, f"word{i} {'foul' if i % 2 else 'fair'} thing") for i in range(200)], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    settings = toxicity.Settings(examples=2000)
    assert {r["predicted"] for r in toxicity.classify(data, marks, settings).collect()} == {0, 1}
    _, texts, truth = toxicity.labelled_sample(data, toxicity.labelled(marks), settings)
    there, here = toxicity.fitted_model(toxicity.sampled(data, toxicity.labelled(marks), settings), settings), train(texts, truth, settings)
    assert all(np.allclose(getattr(there, k), getattr(here, k)) for k in ("word", "gram", "conv", "bias", "out", "base"))


def test_thresholds_weigh_the_rows_they_stand_for():
    cuts, seen = np.array([-1.0, 0.0, 1.0]), np.array([[8.0, 2.0, 0.0], [0.0, 4.0, 6.0]])
    assert toxicity._threshold(seen, np.array([10.0, 10.0]), cuts) == 0.0
    assert toxicity._threshold(seen, np.array([1000.0, 10.0]), cuts) == 1.0


def test_sharding(docs, empty, rows):
    got = sharding.shard_documents(docs, 5).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(5)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(empty).count() == 0
    m = np.array(list(sharding.communication_matrix([10, 0, 7, 2 * 10**9], [10**9, 10**9, 17], 1)))
    assert m.sum(axis=1).tolist() == [10, 0, 7, 2 * 10**9] and m.sum(axis=0).tolist() == [10**9, 10**9, 17] and (m >= 0).all()
    plan = sharding.uniform_shards(docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_law():
    """Counts of single draws against the distribution, and of whole matrices against its mean and variance, by chi-square."""
    rng, good, bad, n = np.random.default_rng(1), 9, 14, 8
    weights = np.array([math.comb(good, k) * math.comb(bad, n - k) for k in range(n + 1)]) / math.comb(good + bad, n)
    got = np.bincount([sharding.hypergeometric(rng, good, bad, n) for _ in range(20000)], minlength=n + 1)
    assert ((got - 20000 * weights) ** 2 / (20000 * weights)).sum() < 26.1  # 8 degrees of freedom, one in a thousand
    draws = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(400)]
    sd = math.sqrt(10**6 * 0.75 * 0.25)
    assert abs(np.mean(draws) - 750_000) < 4 * sd / 20 and 0.8 < np.std(draws) / sd < 1.2
    sizes, shards = [30, 50, 20], [40, 40, 20]
    some = np.array([list(sharding.communication_matrix(sizes, shards, seed)) for seed in range(3000)])
    mean = np.outer(sizes, shards) / 100
    variance = mean * (1 - np.array(shards) / 100) * (100 - np.array(sizes)[:, None]) / 99
    assert (np.abs(some.mean(axis=0) - mean) < 4.5 * np.sqrt(variance / 3000)).all() and (np.abs(some.var(axis=0) / variance - 1) < 0.15).all()


def test_sharding_is_uniform(spark):
    """Where rows lie in the input says nothing of shard and slot: ten by ten parts of either are filled alike."""
    data = spark.range(0, 30000, 1, 7).withColumnRenamed("id", "shard").withColumn("slot", F.lit("x")).withColumn("i", F.col("shard"))
    got = sharding.uniform_shards(data, 5).collect()
    assert set(got[0].asDict()) == {"i", "shard", "slot"} and sorted(r["i"] for r in got) == list(range(30000))
    seen = np.zeros((10, 5, 10))
    for r in got:
        seen[r["i"] // 3000, r["shard"], r["slot"] // 600] += 1
    for table in (seen.sum(axis=1), seen.sum(axis=2), seen.reshape(10, 50)):
        mean, free = table.sum() / table.size, (table.shape[0] - 1) * (table.shape[1] - 1)
        assert abs(((table - mean) ** 2 / mean).sum() - free) < 4.5 * math.sqrt(2 * free)


def test_packing(docs, empty, rows):
    _, encode = library(queries.BYTE_BPE)
    got = packing.pack_documents(docs, queries.BYTE_BPE).collect()
    said = collections.Counter()
    for d, text, *_ in rows:
        ids, at = np.array([*encode(text), 2], dtype="<u4"), 0
        for k in range(-(-len(ids) // 1024)):
            n = (len(ids) - 1) % 1024 + 1 if k == 0 else 1024
            said[(d, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at += n
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == said
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(held)) and held[0][0] == 0 and sum(held[-1]) <= 1024
    assert packing.pack_documents(empty, queries.BYTE_BPE).count() == 0
    same = packing.pack_documents(docs.where("doc_id = 3").crossJoin(docs.sparkSession.range(700).select()), queries.BYTE_BPE).collect()
    held = collections.Counter(r["sequence_id"] for r in same)
    assert len(same) == 700 and len(held) == -(-700 // (1024 // same[0]["length"]))
    counts = np.bincount(np.random.default_rng(2).integers(1, 1025, 40_000), minlength=1025)
    plan = packing.configurations(counts)
    assert (sum(np.bincount(c, minlength=1025) * n for c, n in plan) == counts).all()
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 1024))
    fractions = packing.program(counts)
    covered = np.zeros(1025)
    for c, x in fractions.items():
        assert sum(n * k for n, k in c) <= 1024
        for n, k in c:
            covered[n] += k * x
    assert np.allclose(covered, counts, atol=1e-3)
    assert packing.lower_bound(counts) <= sum(fractions.values()) <= 1.002 * packing.lower_bound(counts)
    whole, left = packing.rounded(fractions, counts)
    assert left.sum() < 0.02 * counts.sum() and all(sum(c) <= 1024 for c, _ in whole)
    big = np.zeros(1025, dtype=np.int64)
    big[600], big[300] = 1000, 100
    assert packing.lower_bound(big) == sum(n for _, n in packing.configurations(big)) == 1000
    assert packing.configurations(np.zeros(1025, dtype=np.int64)) == []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substrings(docs, empty, rows):
    for window in (5, 35):
        seen = collections.Counter(tuple(w[i : i + window]) for w in (words(t) for _, t, *_ in rows) for i in range(len(w) - window + 1))
        said = collections.Counter()
        for d, t, *_ in rows:
            w = words(t)
            gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
            said[(d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())] += 1
        assert collections.Counter(map(tuple, substrings.repeat_digests(docs, window).collect())) == said
    assert substrings.repeat_digests(empty).count() == 0
    assert substrings.remove_repeats(docs).columns == ["doc_id", "text", "lang", "row", "shard", "kept", "n_words", "n_removed"]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def components_of(rows, k, percent=80):
    """Smallest doc_id that each distinct set of rows (doc_id, text) reaches."""
    least = {}
    for d, t in rows:
        s = shingles(t, k)
        if d is not None and s:
            least[s] = min(d, least.get(s, d))
    root = dict(least)
    for _ in root:
        before = dict(root)
        for a, b in itertools.combinations(root, 2):
            if 100 * len(a & b) >= percent * len(a | b):
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return root


def judged(rows, k):
    root = components_of(rows, k)
    told = ((d, shingles(t, k)) for d, t in rows)
    return collections.Counter((d, len(s), root.get(s, d) if d is not None else None, d is None or root.get(s, d) == d) for d, s in told)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, empty, rows, k):
    assert collections.Counter(map(tuple, near_dup.near_duplicates(docs, k).collect())) == judged([r[:2] for r in rows], k)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_one_doc_id(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten"
    told = [(5, a), (5, b), (7, b + " eleven"), (5, b), (9, a.upper())]
    for order in itertools.permutations(told, 5):
        if order[0] in told[:2]:
            got = near_dup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), 2).collect()
            assert collections.Counter(map(tuple, got)) == judged(told, 2)
            break


def variants(n, words_in=60, changed=5, seed=2):
    """n texts that differ from one another in about that many words: many are linked with the first, many are not."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words_in)]
    out = []
    for i in range(n):
        text = list(base)
        for j in rng.choice(words_in, int(rng.integers(1, changed + 1)), replace=False):
            text[j] = f"x{i}-{j}"
        out.append(" ".join(text))
    return out


def test_near_duplicates_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", 8)
    monkeypatch.setattr(near_dup, "PART", 16)
    told = list(enumerate(variants(90)))
    data = spark.createDataFrame(told, "doc_id long, text string").repartition(3)
    assert collections.Counter(map(tuple, near_dup.near_duplicates(data, 2, block=7).collect())) == judged(told, 2)


def test_tiles_give_less_links_than_components():
    """Texts of a few components that are all similar: a link each joins these, not one for every two texts."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words, f"x{i}"]) for i in range(60)] + [f"a lone text {i}" for i in range(4)]
    labels = [i % 5 for i in range(60)] + list(range(60, 64))

    def compared(texts, labels, x, y, first):
        n = len(texts)
        columns = {"node": range(n), "hub": [0] * n, "x": x, "y": y, "first": first, "component": labels, "text": texts}
        return near_dup._compare_tiles(2, 80)(pa.table({c: list(v) for c, v in columns.items()}))

    got = compared(texts, labels, [0] * 64, [0] * 64, [True] * 64).to_pydict()
    assert len(got["a"]) == 4 and set(got["a"]) | set(got["b"]) == set(range(5)) and all(a > b for a, b in zip(got["a"], got["b"]))
    got = compared(texts, labels, [0] * 64, [1] * 64, [i < 30 for i in range(64)]).to_pydict()
    assert len(got["a"]) == 4 and set(got["a"]) | set(got["b"]) == set(range(5))


def test_frequent_keys_go_by_broadcast(spark, monkeypatch):
    from quillspark.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 3)
    told = [(i, "same words here again" if i % 3 else f"text of its own number {i}") for i in range(60)] + list(enumerate(variants(30), 100))
    data = spark.createDataFrame(told, "doc_id long, text string").repartition(3)
    assert collections.Counter(map(tuple, near_dup.near_duplicates(data, 2).collect())) == judged(told, 2)


def test_dropping_near_duplicates(spark, empty):
    told = [(1, None, "a"), (1, None, "a"), (None, "no id at all", "b"), (None, "no id at all", "b"), (3, "one two three four five six", "c"), (3, "one two three four five six", "c"), (4, "one two three four five six", "d"), (5, "", "e")]
    data = spark.createDataFrame([(d, t, c, 1, 2, 3) for d, t, c in told], "doc_id long, text string, row string, at int, file int, _kept_id int")
    got = near_dup.drop_near_duplicates(data)
    assert got.columns == data.columns
    assert collections.Counter((r["doc_id"], r["row"]) for r in got.collect()) == {(1, "a"): 2, (None, "b"): 2, (3, "c"): 1, (5, "e"): 1}
    assert near_dup.drop_near_duplicates(empty).count() == 0


def test_entries_hold_the_bound():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, (200, near_dup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dup.SYMBOLS, near_dup.BOUND, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, near_dup.BOUND).astype(np.uint16)
    assert all(set(x) & set(y) for x, y in zip(near_dup.entries(a).tolist(), near_dup.entries(b).tolist()))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 8)).astype(np.float32)
    x[50:60] = x[49]
    return x


@pytest.fixture(scope="module")
def vector_rows(spark, vectors):
    odd = [(400, None), (420, [None] * 8), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, [1.0] * 8)]
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(i, v, 1) for i, v in odd], "vec_id long, embedding array<float>, score int")


def best(ids, said, own, k=20):
    m = ids != own
    order = np.lexsort((ids[m], -said[m]))[:k]
    return list(zip(ids[m][order].tolist(), said[m][order].tolist()))


def answers(found):
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_max_score(spark, vectors, vector_rows):
    ids, f = np.arange(300), np.floor(64 * vectors.astype(float)).astype(np.int64)
    got = answers(maxscore.top_k(vector_rows, shard_rows=100, block_rows=8, block=16))
    assert set(got) == set(range(0, 300, 20)) and all(got[q] == best(ids, f @ f[q], q) for q in got)
    assert maxscore.top_k(vector_rows.limit(0)).count() == 0
    few = answers(maxscore.top_k(vector_rows.where("vec_id < 7")))
    assert list(few) == [0] and len(few[0]) == 6


def test_repeated_query_rows_ask_once(spark):
    told = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 0.0]), *[(i, [float(i), 1.0]) for i in range(1, 9)], (3, [3.0, 1.0])]
    data = spark.createDataFrame(told, "vec_id long, embedding array<float>")
    for found in (maxscore.top_k(data, k=4, scale=1), vptree.neighbours(data, k=4, factor=1.0)):
        assert answers(found)[0] == [(8, 8), (7, 7), (6, 6), (5, 5)]
    assert answers(maxscore.top_k(data, k=8, scale=1))[0][-4:] == [(4, 4), (3, 3), (3, 3), (2, 2)]


@pytest.mark.parametrize("kind", [1, 1 << 18, 1 << 40])
def test_max_score_passes_blocks_and_probes_few(kind):
    """Clusters: most blocks of a query are passed over, and the answers are those of brute force in each number type."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-40, 40, (20, 16))
    v = (centres[rng.integers(0, 20, 4000)] + rng.integers(-3, 4, (4000, 16))).astype(np.int64) * kind
    ids = rng.permutation(4000).astype(np.int64)
    if kind > 1 << 30:
        v, ids = v[:300], ids[:300]
    shard = maxscore.Shard(ids, v, 20, 64)
    asks = np.flatnonzero(ids % 20 == 0)
    top = shard(ids[asks], v[asks])
    for i, q in enumerate(asks):
        said = np.array([sum(int(a) * int(b) for a, b in zip(x, v[q])) for x in v], dtype=object) if kind > 1 << 30 else v @ v[q]
        assert list(zip(top.ids[i].tolist(), map(int, top.scores[i]))) == [(a, int(b)) for a, b in best(ids, said, ids[q])]
    if kind == 1:
        assert shard.passed > 0.5 * len(asks) * len(shard.cuts) and shard.probed < 0.5 * shard.pairs


@pytest.mark.parametrize("factor", [1.0, None])
def test_vantage_points(spark, vectors, vector_rows, factor):
    ids, x = np.arange(300), vectors.astype(float)
    zero = spark.createDataFrame([(500, [0.0] * 8, 1), (520, [-0.0] * 8, 1)], vector_rows.schema)
    got = answers(vptree.neighbours(vector_rows.unionByName(zero), factor=factor, shard_rows=150))
    assert set(got) == set(range(0, 300, 20))
    true = {q: best(ids, vptree.products(x, np.full(300, q), x, ids), q) for q in got}
    assert np.mean([len(set(got[q]) & set(true[q])) / 20 for q in got]) >= (1.0 if factor else 0.9)
    if factor:
        assert got == true
    assert vptree.neighbours(vector_rows.limit(0)).count() == 0


def test_trees_prune():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (60, 8))[rng.integers(0, 60, 6000)] + rng.normal(0, 0.05, (6000, 8))
    ids = np.arange(6000)
    asks = ids % 20 == 0
    for factor, most in ((1.0, 0.7), (None, 0.5)):
        tree = vptree.Tree(ids, x, float((x * x).sum(axis=1).max()), 20, factor, 0.96)
        top = tree(ids[asks], x[asks])
        hit = [len(set(top.ids[i].tolist()) & {v for v, _ in best(ids, x @ x[q], q)}) / 20 for i, q in enumerate(ids[asks])]
        assert np.mean(hit) >= (1.0 if factor else 0.93) and tree.visited < most * tree.asked


def test_html(spark):
    prose = "Some long sentence, with commas, that goes on for a while and says a lot of things, as prose does. " * 3
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header><p>Site</p></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="ad">Buy, now, this, thing, and, that.</div><div id=content><h1>Ti&amp;tle</h1><p>{prose}</p><p>Two&nbsp; words<br>here<p>{prose}<ul><li>item</ul></div>
    <div class="comments"><p>{prose}</p></div><aside>{prose}</aside><form>{prose}</form><script>x("<p>")</script><footer>{prose}</footer></body></html>"""
    p = prose.strip()
    assert html_text.main_text(page) == f"Ti&tle\n{p}\nTwo words here\n{p}\nitem"
    data = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", "<p>x")], "page_id long, url string, html string")
    got = [tuple(r) for r in html_text.extract_main_text(data).orderBy("page_id", "n_chars").collect()]
    assert got[1:] == [(2, None, "", 0), (3, "v", "", 0), (3, "v", "x", 1)] and got[0][3] == len(got[0][2])


def test_html_keeps_the_article_whole():
    page = """<body><div class="search">find, this, please, now, and, more, words, here</div><article><header><h1 id="related-work">Related work</h1></header>
    <p style="overflow:hidden">One, two, three, four and five and six and seven.</p><math><mi>x</mi><annotation encoding="application/x-tex">x</annotation></math>
    <figure><img src=a><figcaption>A figure</figcaption></figure><div class="search">Engines do it.</div><div class="related-work">Others did, too.</div>
    <p title="the hidden cost">cost</p><p hidden>no</p><div class="comments"><p>Reader, says, so.</p></div><div class="ad-banner">Buy</div><p>if a < b and c</article>"""
    assert html_text.main_text(page).split("\n") == ["Related work", "One, two, three, four and five and six and seven.", "x", "A figure", "Engines do it.", "Others did, too.", "cost", "if a < b and c"]


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<div>x", "<p><b>", '<a "x>" y', "<b><div><i></b>", "<article>x", "<svg>", "<", "</p>", "<td>", "<li>", "<!--", "<p hidden", "&"])
def test_html_in_linear_time(unit):
    import time

    began = time.process_time()
    html_text.main_text(unit * (200_000 // len(unit)))
    assert time.process_time() - began < 5


def plain_article(page):
    """The same by other means, for pages whose article is marked: the standard parser, and a list of what is not read."""
    from html.parser import HTMLParser

    blocks, line, skipped, inside = [], [], [], []

    def flush():
        if said := " ".join("".join(line).split()):
            blocks.append(said)
        line.clear()

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if skipped or tag in ("nav", "footer", "aside", "script", "style", "form") or dict(attrs).get("class") == "ad":
                skipped.extend([tag] if tag not in ("br", "meta", "img") else [])
            inside.extend([tag] if tag == "article" else [])
            self.edge(tag)

        def handle_endtag(self, tag):
            if skipped and tag in skipped:
                del skipped[len(skipped) - 1 - skipped[::-1].index(tag) :]
            self.edge(tag)
            if tag == "article":
                inside.clear()

        def edge(self, tag):
            if tag in ("p", "h1", "h2", "li", "ul", "div", "article"):
                flush()
            elif tag == "br":
                line.append(" ")

        def handle_data(self, data):
            if inside and not skipped:
                line.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    flush()
    return "\n".join(blocks)


def test_html_equals_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    found = html_text.extract_main_text(pages.withColumn("text", F.lit("x"))).collect()
    assert len(found) == len(html) and all(r["text"] == plain_article(html[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in found)
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def test_chunks_join_to_texts():
    import pyarrow as pa

    texts = ["a  b", " x", "x ", "", "a \nb <|endoftext|> c", "plain words here"]
    codes, at, parts = chunks.chunked(pa.array(texts, pa.large_string()), ("<|endoftext|>",))
    assert ["".join(parts[c] for c in codes[a:b]) for a, b in itertools.pairwise(at)] == texts


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A table with toxic texts, near copies, passages that repeat, nulls, repeated rows and a clashing column."""
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = text(60)
    told, toxic = [], {}
    for i in range(240):
        said = text(80)
        if i % 4 == 0:
            said, toxic[i] = " ".join([said[:200], "zork blag", said[200:], "zork"]), 1
        elif i % 10 == 1:
            said = f"{said} {passage} {text(20)}"
        told.append((i, said))
        toxic.setdefault(i, 0)
    base = [t for i, t in told if i % 4 == 3][:6]
    told += [(300 + i, t + " end") for i, t in enumerate(base)] + [(320, base[0]), (320, base[0]), (330, None), (331, ""), (332, " "), (None, text(50))]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(d, t, len(t or ""), "k") for d, t in told], "doc_id long, text string, n_chars long, kept string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, told, toxic


def test_pipeline_against_brute_force(spark, planted):
    import corpus_pipeline

    folder, told, toxic = planted
    docs, rows = spark.read.parquet(f"{folder}/documents.parquet"), told
    stages, pairs = dict(corpus_pipeline.STAGES), lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    # 1: marked documents go
    got = stages["toxicity"](spark, docs, folder)
    assert got.columns == docs.columns
    marked = {r["doc_id"] for r in toxicity.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(d, t) for d, t in rows if d not in marked or not words(t)]
    assert pairs(got) == sorted(rows, key=repr)
    assert sum(toxic[d] for d in marked if d in toxic) >= 0.95 * sum(toxic.values()) and not [d for d in marked if not toxic.get(d)]
    # 2: one of each group stays
    docs = got
    got = stages["near_dedup"](spark, docs, folder)
    assert got.columns == docs.columns
    root, seen, kept = components_of(rows, 5), set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        c = root.get(shingles(t, 5)) if d is not None else None
        if c is None or c not in seen:
            kept.append((d, t))
        seen |= {c} - {None}
    assert pairs(got) == sorted(kept, key=repr)
    # 3: passages of 35 words that start twice go
    docs, rows = got, kept
    got = stages["substring_dedup"](spark, docs, folder)
    assert got.columns == docs.columns
    said = collections.Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t in rows) for i in range(len(w) - 34))
    left = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - 34) if said[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        left.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    assert sum(a != b for a, b in zip(rows, left)) > 5 and pairs(got) == sorted(left, key=repr)
    assert got.where(F.length("text") != F.col("n_chars")).isEmpty()
    # 4: every piece of every text once, and the whole run
    _, encode = library(queries.BYTE_BPE)
    pieces = collections.Counter((d, zlib.crc32(np.array([*encode(t or ""), 2], dtype="<u4").tobytes())) for d, t in left)
    for packed in (stages["packing"](spark, got, folder), corpus_pipeline.run(spark, folder)):
        found = packed.collect()
        assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in found) == pieces
        by = collections.defaultdict(list)
        for r in found:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        assert all(sorted(h)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(h))) and sum(n for _, n in h) <= 1024 for h in by.values())


def test_pipeline_of_nothing(spark, planted, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{planted[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    said = c.execute(queries.ORACLES["op7_near_dedup"]).fetchall()
    assert collections.Counter(map(tuple, queries.op7_near_dedup(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect())) == collections.Counter(said)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() and set(out.columns) >= {"doc_id", "sequence_id", "offset"}


PARA = "Words of an article, with commas, and more words to make it long enough to have points of its own. "


@pytest.mark.parametrize(
    "page, text",
    [
        # siblings stay whatever their points: a list, a short section, a heading, a figure
        (f"<div><div class=a><p>{PARA * 3}</p><p>{PARA}</p><p>{PARA}</p></div><h2>More</h2><ul><li>one</li><li>two</li></ul><div class=b><p>{PARA}</p></div><figure><figcaption>Cap</figcaption></figure></div>", [PARA * 3, PARA, PARA, "More", "one", "two", PARA, "Cap"]),
        # marked paragraphs and headings go, inside an article too
        (f"<article><h1>T</h1><p>{PARA}</p><p class='advertisement'>Buy now</p><h2 class=newsletter>Join us</h2><p class='social'>Share</p><p>{PARA}</p></article>", ["T", PARA, PARA]),
        # an unmarked list of links beside the text goes, by its density
        (f"<body><div><a href=1>A link that is long enough</a> <a href=2>Another link that is long</a></div><div><p>{PARA}</p><p>{PARA}</p></div><ul><li><a href=3>three</a></li></ul></body>", [PARA, PARA]),
        # the article tag does not win against the text of the page
        (f"<body><article><p><a href=1>{PARA}</a></p></article><div><p>{PARA * 2}</p><p>{PARA * 3}</p></div></body>", [PARA * 2, PARA * 3]),
        # sections of an article in containers of their own
        (f"<div id=page><section><p>{PARA * 2}</p></section><section><h3>S</h3><p>{PARA}</p></section><section><p>short</p></section></div>", [PARA * 2, "S", PARA, "short"]),
        # forms go, those around a page among them, and what is shown without scripts only
        (f"<form><p>{PARA}</p></form>", []),
        (f"<p>{PARA}</p><noscript><p>{PARA}</p></noscript>", [PARA]),
        ("<p>too short for points</p><p>and another</p>", ["too short for points", "and another"]),
    ],
)
def test_scores_decide(page, text):
    assert html_text.main_text(page) == "\n".join(t.strip() for t in text)
    for tag in ("div", "section"):
        if "newsletter" in page:
            assert html_text.main_text(page.replace("article>", f"{tag}>")) == "\n".join(t.strip() for t in text)


@pytest.mark.parametrize("search", [vptree.neighbours, maxscore.top_k])
def test_order_and_place_of_rows_change_nothing(spark, search, tmp_path):
    """Rows in another order, other files and other partitions, some of them many times over."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(900)]
    rows += rows[:3] * 30
    said = []
    for k, parts in enumerate((1, 5)):
        spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "vec_id long, embedding array<float>").repartition(parts).write.parquet(str(tmp_path / f"{k}"))
        found = search(spark.read.parquet(str(tmp_path / f"{k}")), shard_rows=300, block_rows=20)
        said.append(sorted(map(tuple, found.collect())))
    assert said[0] == said[1] and len(said[0]) >= 45 * 20


def plain_logit(model, text):
    """The classifier word by word: hashed rows, every filter at every word, the largest response of each, one sum."""
    s, blank = model.settings, np.zeros(model.settings.width)
    vectors = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        word = word.lower().strip(toxicity._EDGES) or word
        vector = model.word[xxhash.xxh3_64_intdigest(f"<{word}>".encode()) % s.buckets] * 0.3
        grams, data = [], f"<{word}>".encode()
        for n in (3, 4, 5, 6):
            for i in range(len(data) - n + 1):
                h = (2166136261 + n) % 2**32
                for b in data[i : i + n]:
                    h = (h ^ b) * 16777619 % 2**32
                grams.append(model.gram[(h ^ h >> 15) % s.buckets])
        vectors.append(vector + (np.sum(grams, axis=0) / len(grams) ** 0.5 if grams else 0))
    total, k = model.base, 0
    for w in toxicity.WIDTHS:
        for f in range(s.filters):
            said = [0.0]
            for i in range(len(vectors)):
                window = [*vectors[i : i + w], *[blank] * w][:w]
                said.append(sum(float(v @ model.conv[:, model.taps.index((w, j)) * s.filters + f]) for j, v in enumerate(window)))
            total += max(0.0, max(said) + float(model.bias[k])) * float(model.out[k])
            k += 1
    return total


def test_toxicity_forward_pass():
    """Scores against plain loops; a text's score is its own, whatever stands beside it."""
    rng = np.random.default_rng(5)
    words = ["Zork,", "blag", "a", "é", "word", "日本", "(x)", "--", "longerword"]
    texts = ["", " ", "a", *(" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(40)), "zork " * 300]
    model = toxicity.train(texts, np.arange(len(texts)) % 2, toxicity.Settings(buckets=1 << 12, examples=200))
    model.bias += rng.normal(0, 0.1, len(model.bias)).astype(np.float32)

    def said(some):
        codes, offsets, distinct = split_words(pa.array(some, pa.large_string()))
        return model.logits(codes, offsets, toxicity.words_of(distinct, 1 << 12))

    whole = said(texts)
    assert np.allclose(whole, [plain_logit(model, t) for t in texts], atol=1e-3)
    assert np.allclose(whole, [said([t])[0] for t in texts], atol=1e-4) and np.allclose(whole[::-1], said(texts[::-1]), atol=1e-4)


def test_texts_longer_than_a_slice(spark):
    """Nine megabytes in one text: its repeats, its copy and its score are found as those of any other."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 1_200_000)]
    passage = [f"passage{i}" for i in range(40)]
    long = " ".join([*words[:600_000], *passage, *words[600_000:]])
    assert len(long) > 8 << 20
    rows = [(0, long), (1, " ".join(["before", *passage, "after"])), (2, long.replace("passage7 ", "other ")), (3, "short"), (4, None)]
    data = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.repeat_digests(data.where("doc_id in (0, 1, 3, 4)")).collect()}
    assert removed == {0: (1_200_040, 40), 1: (42, 40), 3: (1, 0), 4: (0, 0)}
    groups = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(data, shingle=2).collect()}
    assert groups == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(data, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")).collect()}
    assert set(scores) == {0, 1, 2, 3, 4} and all(0 <= s <= 1 for s in scores.values())


def test_words_are_encoded_as_their_texts_are():
    """Ids by words are the library's of the whole texts, and what is encoded are bodies and tails, not every word that they make."""
    spec, other = (open(path, encoding="utf-8").read() for path in (queries.WORD_BPE, queries.BYTE_BPE))
    encoder = chunks.LibraryEncoder(spec)
    assert encoder.by_words and not chunks.LibraryEncoder(other).by_words
    rng = random.Random(11)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "the", "Word", "ÉCOLE", "straße", "µ", "ª", "İ", "ı", "į", "Į", "ŉ", "Å", "Å", "́", "ΣΑΣ", "ﬁ", "探针", "12", "²", "_", "'s", "'", "'ll", "&&&", "!", "...", "(", "≠", "<|endoftext|>", "<|startoftext|>", "<|end", "👍", "x1", "\0"]
    texts = ["", " ", "\n\n", "a"] + ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000)]
    ids, at = chunks.encoded(pa.array(texts, pa.large_string()), encoder, encoder.specials)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    for few in ([], [""], [" \n"]):
        ids, at = chunks.encoded(pa.array(few, pa.large_string()), encoder, encoder.specials)
        assert not len(ids) and at.tolist() == [0] * (len(few) + 1)
    fresh = chunks.LibraryEncoder(spec)
    chunks.encoded(pa.array(["Some some. SOME, some!!! Some?\nsome; some..."], pa.large_string()), fresh, fresh.specials)
    assert list(fresh.known) == ["some"]
