import random

import numpy as np
from pyspark.sql import functions as F

from sylva.llm import near_dup, shingles
from sylva.llm.common import Scratch
from tests.llm.helpers import documents, sentence


def word_sets(rows, n):
    out = {}
    for k, text in rows:
        w = (text or "").encode().lower().split()
        w = [x for x in w if x]
        out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def brute(rows, n, percent=80):
    sets = word_sets(rows, n)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = sentence(rng, rng.randint(3, 120)).split()
        for _ in range(rng.randint(1, 7)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randint(0, 99))
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(900, ""), (901, None), (902, " \n\t "), (903, "one"), (904, "ONE"), (905, "one two")]
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    for n in (2, 5):
        got = near_dup.near_duplicates(documents(spark, rows, extra=True), shingle=n).collect()
        want = brute(rows, n)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_stars_alone_do_not_decide(spark):
    """A chain of shifted texts: members of a bucket that fail against one hub still find each other."""
    words = [f"w{i}" for i in range(140)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(25)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, rows), shingle=2).collect()}
    assert got == {k: v[1] for k, v in brute(rows, 2).items()}


def _pairs_let_through(sets, percent=80):
    n = np.array([len(s) for s in sets])
    return set(near_dup.close_pairs(n, np.arange(len(sets)), np.zeros(len(sets)), [near_dup.sketch(s) for s in sets], percent))


def _true_pairs(sets, percent=80):
    return {(max(i, j), min(i, j)) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}


def test_no_link_of_a_bucket_is_refuted_by_sketches():
    """Sets of all sizes around the threshold, of several widths of sketches."""
    rng = np.random.default_rng(8)
    for percent in (80, 30):
        sets = []
        for size in (5, 64, 65, 130, 700, 9000):
            union = rng.integers(0, 2**63, size * 2, dtype=np.uint64) * np.uint64(2)
            sets += [np.sort(union[:size])] + [np.sort(union[size * k // 40 : size * k // 40 + size]) for k in (1, 3, 4, 5, 8, 20)] + [np.sort(union[: size * 4 // 5]), np.sort(union[: size // 3])]
        got = {(max(p), min(p)) for p in _pairs_let_through(sets, percent)}
        want = _true_pairs(sets, percent)
        assert want <= got and len(got) < (1.6 if percent == 80 else 2) * len(want)


def test_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(9)
    for size in (1, 5, 200, 4000):
        base = rng.integers(0, 2**63, size * 2, dtype=np.uint64)
        for _ in range(20):
            a, b = (rng.choice(base, rng.integers(1, size + 1), replace=False) for _ in range(2))
            both = near_dup.Sketches([near_dup.sketch(a), near_dup.sketch(b)])
            w = int(both.width.min())
            x, y = (both.at(int(v), w)[both.place[k]] for k, v in enumerate(both.width))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_blocks_of_a_large_bucket_meet_once(spark):
    """Every pair of different groups is compared in one block at least, and no pair twice."""
    rng = np.random.default_rng(5)
    sets = {}
    for k in range(90):
        base = np.arange(40, dtype=np.uint64) * np.uint64(7919) + np.uint64(1 << 40)
        sets[k] = np.sort(np.concatenate([base, rng.integers(0, 2**62, int(rng.integers(0, 6)), dtype=np.uint64)]))
    comp = {k: 0 if k < 60 else 60 + k % 7 for k in sets}
    table = spark.createDataFrame([(k, len(s), s.view(np.int64).tolist(), near_dup.sketch(s)) for k, s in sets.items()], "id long, n long, shingles array<long>, sketch binary")
    members = spark.createDataFrame([(1, k, comp[k]) for k in sets] + [(2, k, 0) for k in range(5)], "key long, id long, comp long")
    want = {(i, j) for i in sets for j in sets if i > j and comp[i] != comp[j]}
    for block in (4, 16, 1000):
        assert {(r.a, r.b) for r in near_dup.open_pairs(members, table, 30, block).collect()} == want
        dealt = near_dup.blocks_of(members, block).groupBy("key", "i", "j", "side").count().collect()
        assert block == 1000 or max(r["count"] for r in dealt) < 4 * block
        assert not any(r.key == 2 for r in dealt)


def test_different_texts_of_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words[:30]), " ".join(words[30:])
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, "x y z")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, rows), shingle=2).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8}


def test_temporary_tables_are_removed(spark):
    import glob

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/cut-*"))
    near_dup.near_duplicates(documents(spark, corpus()), shingle=2).count()
    assert len(set(glob.glob(f"{folder}/cut-*")) - before) == 2


def test_edge_cases(spark):
    empty = documents(spark, []).limit(0)
    assert near_dup.near_duplicates(empty).count() == 0
    df = documents(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (7, None)])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("7", 0, "7", True), ("None", 3, "None", False)]


def test_long_text_is_hashed_whole():
    text = ("ab " * 700_000 + "end tail").encode()
    starts, words = shingles.word_hashes(shingles.fold(text))
    assert len(words) == 700_002 and len(set(words.tolist())) == 3
    assert len(shingles.shingle_sets([text], 2)[0]) == 3
    a, b = shingles.shingle_sets([b"x  Y", b"X\ty z"], 2)
    assert set(a) < set(b)
    assert shingles.shingle_sets([b"", b"q"], 2)[0].size == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    sketch = near_dup.Sketcher(40, 5)
    for size in (3, 30, 3000):
        base = rng.integers(0, 2**63, size * 10, dtype=np.uint64)
        got = []
        for k in range(10 if size > 100 else 60):
            part = rng.choice(base, size, replace=False)
            other = np.concatenate([part[: size * 4 // 5], rng.integers(0, 2**63, size - size * 4 // 5, dtype=np.uint64)])
            j = len(np.intersect1d(part, other)) / len(np.union1d(part, other))
            got.append((sketch.signature(np.sort(part)) == sketch.signature(np.sort(other))).mean() - j)
        assert abs(np.mean(got)) < 0.05


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(100, 105).select(F.col("id").alias("a"), F.lit(110).cast("long").alias("b")))
    comp = {r.id: r.comp for r in near_dup.components(edges, Scratch(spark)).collect()}
    assert all(comp[i] == 0 for i in range(1, 61)) and all(comp[i] == 100 for i in (101, 102, 103, 104, 110))
