import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexigraph.llm import _common, near_dedup
from plexigraph.llm.components import components, label_least
from tests.llm.brute import near_components, shingles


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def want(rows, **k):
    return sorted(((rows[n][0], s, c) for n, (s, c) in near_components(rows, **k).items()), key=repr)


def corpus(seed, groups=12, size=9):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(20, 90))]
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = f"v{r.randrange(1000)}"
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows


def test_shingle_sets_match_tuples():
    texts = ["A b  c\td e", "a B c d e", "a b", "", None, "\n x", "a b c d e a b c d e", "ü Ü ü ü"]
    for k in (4, 5):
        for t, s in zip(texts, near_dedup.shingle_sets(texts, k), strict=True):
            assert len(s) == len(shingles(t, k))
        a, b = near_dedup.shingle_sets(texts[:2], k)
        assert (a == b).all()
    short, other = near_dedup.shingle_sets(["a b", "a b c"], 4)
    assert short[0] != other[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(make, seed):
    rows = corpus(seed)
    assert result(near_dedup.near_duplicates(make(rows), words=4)) == want(rows)


def test_regions_and_blocks_that_overflow(make):
    """Tiny bounds send everything through prefix cuts, salted remainders and block pairs."""
    rows = corpus(4, groups=3, size=60) + [(1000 + i, " ".join(f"c{k}" for k in range(40)) + f" t{i}") for i in range(40)]
    assert result(near_dedup.near_duplicates(make(rows), words=4, region=5, block=6)) == want(rows)


def test_star_of_copies_across_blocks(make):
    base = [f"b{k}" for k in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        w = list(base)
        w[(2 * i) % 60] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert result(near_dedup.near_duplicates(make(rows), words=4, region=4, block=3)) == want(rows)


def test_edge_cases(make):
    rows = [(5, None), (6, ""), (7, "one two"), (7, "one two"), (3, "ONE  two"), (None, "one two three four five"), (None, "one two three four five"), (8, "long " * 30_000), (2, "long " * 30_001)]
    got = result(near_dedup.near_duplicates(make(rows).withColumnRenamed("source", "kept"), words=4))
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 1, 3), (7, 1, 3), (3, 1, 3), (None, 2, None), (None, 2, None), (8, 1, 2), (2, 1, 2)], key=repr)
    kept = near_dedup.dedup_near(make(rows), words=4)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([5, 6, 3, None, 2], key=repr)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table(make):
    assert near_dedup.near_duplicates(make([])).count() == 0
    assert near_dedup.dedup_near(make([(1, None)])).count() == 1


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, one_task):
    r = random.Random(6)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(40)]
    want = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long"), one_task).collect()}
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_signature_estimates_similarity():
    r = np.random.default_rng(5)
    a = np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64))
    b = np.concatenate([a[:2400], np.unique(r.integers(0, 2**63, 600, dtype=np.uint64))])
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - 2400 / 3600) < 0.2


def crowd(n, twins, shared, seed=8):
    """n texts of which any two share `shared` of their 4-word shingles, and twins at a similarity of just over 0.8."""
    r = random.Random(seed)
    common = [f"c{k}" for k in range(200)]
    own = int(200 * (1 - shared) / (2 * shared))
    rows = []
    for i in range(n):
        words = common + [f"u{i}x{k}" for k in range(own)]
        rows.append((2 * i, " ".join(words)))
        if i < twins:
            w = list(words)
            for k in r.sample(range(4, len(w) - 4), 1):
                w[k] = f"t{i}"
            tail = max(0, len(w) // 11 - 4)
            rows.append((2 * i + 1, " ".join(w[: len(w) - tail] + [f"y{i}x{k}" for k in range(tail)])))
    r.shuffle(rows)
    return rows


def pair_recall(df, rows):
    """(links of twins found, twins that are links) by component."""
    want = near_components(rows)
    truth = {rows[n][0]: c for n, (_, c) in want.items()}
    got = {r["doc_id"]: r["component_id"] for r in df.collect()}
    twins = [i for i, _ in rows if i % 2 and truth[i] == truth[i - 1]]
    assert all(truth[c] == truth[i] for i, c in got.items())  # nothing is joined that isn't linked
    return sum(got[i] == got[i - 1] for i in twins), len(twins)


@pytest.mark.parametrize("shared", [0.5, 0.6])
def test_recall_in_cut_regions(make, shared):
    """A bound of 20 classes a region cuts a crowd of 700 alike texts some seven columns deep; twins at 0.8 still meet."""
    rows = crowd(600, 100, shared)
    found, all_ = pair_recall(near_dedup.near_duplicates(make(rows), words=4, region=20), rows)
    assert all_ >= 90 and found >= 0.9 * all_


def test_walk_in_order_joins_what_estimates_join():
    r = np.random.default_rng(4)
    for _ in range(20):
        base = r.integers(0, 50, (5, near_dedup.COLUMNS), dtype=np.uint32)
        sigs = base[r.integers(0, 5, 60)]
        sigs = np.where(r.random(sigs.shape) < 0.25, r.integers(0, 50, sigs.shape, dtype=np.uint32), sigs)
        sigs = sigs[np.lexsort(sigs.T[::-1])]
        a, b = np.nonzero((sigs[:, None] == sigs[None]).mean(axis=2) >= 0.55)
        steps = np.array(near_dedup.walk_order(sigs, 0.55)).reshape(-1, 2)
        own, want = np.arange(60), label_least(a, b)[1]
        if len(steps):
            ids, least = label_least(steps[:, 0], steps[:, 1])
            own[ids] = least
        assert (own == want).all() and len(steps) == 60 - len(np.unique(want))


def test_components_of_odd_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None), (2, 7)], "a long, b long").withColumn("id", F.lit(0)).withColumn("component", F.lit(0))
    for one_task in (0, 100):
        assert {(r["id"], r["component"]) for r in components(e, one_task).collect()} == {(1, 1), (2, 1), (7, 1)}
        assert components(e.limit(0), one_task).count() == 0


def test_query_against_brute_force(spark, sf):
    out = near_dedup.op10_minhash_near_dedup(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(out) == want(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def forest_of(make, rows):
    return near_dedup.sketch(make(rows), 4).select(F.col("doc_id").alias("rid"), "sig", "keys")


def test_walks_are_stored_before_another_python_step(make):
    """Two Python steps in a task hold two workers for each core, and idle ones stay with what they have loaded."""
    steps = near_dedup.forest_edges(forest_of(make, corpus(5)), 1000, 0.55)
    assert "MapInArrow" not in steps._jdf.queryExecution().executedPlan().toString()
    assert steps.count()


def test_cuts_take_several_columns_a_round(make):
    """A crowd cut five columns deep: one round, bounded regions, every member in one, and all of them joined by shared members."""
    base = np.zeros(near_dedup.COLUMNS, np.uint32)
    r = np.random.default_rng(3)
    sigs = [np.concatenate([base[:3], r.integers(0, 2, near_dedup.COLUMNS - 3, dtype=np.uint32)]) for _ in range(150)]
    members = make([(0, "")]).sparkSession.createDataFrame([(7, i, s.tobytes()) for i, s in enumerate(sigs)], "key long, rid long, ordered binary")
    before = _common.stashed()
    cut = near_dedup._cut_regions(members, 20)
    assert _common.stashed() - before <= 6  # it was two a column
    regions = {}
    for x in cut.collect():
        regions.setdefault(x["key"], []).append(x["rid"])
    assert max(map(len, regions.values())) <= 20
    assert {x for own in regions.values() for x in own} == set(range(150))
    pairs = np.array([(own[0], x) for own in regions.values() for x in own])
    ids, least = label_least(pairs[:, 0], pairs[:, 1])
    assert len(ids) == 150 and not least.any()


def test_cuts_of_equal_signatures_and_of_wide_splits(make):
    spark = make([(0, "")]).sparkSession
    same = [(7, i, np.zeros(near_dedup.COLUMNS, np.uint32).tobytes()) for i in range(30)]
    wide = [(8, 100 + i, np.array([1, 1, 1, i, *[i % 3] * (near_dedup.COLUMNS - 4)], np.uint32).tobytes()) for i in range(40)]
    regions = {}
    for x in near_dedup._cut_regions(spark.createDataFrame(same + wide, "key long, rid long, ordered binary"), 15).collect():
        regions.setdefault(x["key"], set()).add(x["rid"])
    assert max(map(len, regions.values())) < 30  # equal ones are dealt by hash, 15 on average, and a shared member comes on top
    pairs = np.array([(min(own), x) for own in regions.values() for x in own])
    ids, least = label_least(pairs[:, 0], pairs[:, 1])
    assert dict(zip(ids.tolist(), least.tolist(), strict=True)) == {**{i: 0 for i in range(30)}, **{100 + i: 100 for i in range(40)}}
