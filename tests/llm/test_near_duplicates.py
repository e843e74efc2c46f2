"""Near duplicates and components on cases made to be awkward."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, near_duplicates

SCHEMA = "doc_id long, text string"


def _text(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def _plain(rows, percent=85):
    """(id, component) of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return Counter((i, least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def _got(df, percent=85):
    return Counter((r["doc_id"], r["component_id"]) for r in near_duplicates.near_duplicates(df, percent).collect())


def test_one_id_with_two_texts_in_all_orders(spark):
    a, b = _text(150, 1), _text(150, 2)
    rows = [(5, a), (5, b), (7, b + " end")]
    for order in itertools.permutations(rows):
        assert _got(spark.createDataFrame(list(order), SCHEMA)) == Counter([(5, 5), (5, 5), (7, 5)])
    rows = [(9, a), (9, b), (7, b + " end"), (None, b + " other end"), (None, _text(9, 3)), (3, a), (9, a)]
    for order in itertools.islice(itertools.permutations(rows), 0, 5040, 1700):
        assert _got(spark.createDataFrame(list(order), SCHEMA)) == _plain(rows)


def test_links_through_a_text_without_id(spark):
    w = _text(200, 4).split()
    middle = w[:180]
    rows = [(4, " ".join(w[:160])), (None, " ".join(middle)), (8, " ".join(w))]
    assert _plain(rows) == Counter([(4, 4), (None, 4), (8, 4)])
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _plain(rows)


@pytest.mark.parametrize("block", [1000, 7])
def test_large_group_of_copies_that_differ(spark, monkeypatch, block):
    """Copies of one text whose own likeness is often below the threshold, so that no centre settles the bucket."""
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", block)
    rng = random.Random(5)
    base = _text(120, 6).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, _text(80, 50 + i)) for i in range(20)]
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _plain(rows)


def test_long_texts(spark):
    """A text of megabytes, its near copy, and one word of megabytes."""
    long_ = _text(300_000, 7)
    rows = [(1, long_), (2, "start " + long_), (3, "y" * 3_000_000), (4, "y" * 3_000_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (299_996, 1), 2: (299_997, 1), 3: (1, 3), 4: (1, 3)}


def test_stage_judges_each_row_by_its_text(spark):
    a, b = _text(150, 1), _text(150, 2)
    rows = [(2, b), (5, a), (5, b), (None, a), (6, None), (None, None)]
    out = near_duplicates.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(map(tuple, out.collect())) == Counter([(2, b), (5, a), (6, None), (None, None)])


def test_components_without_one_union_find(spark, monkeypatch):
    """Hubs, chains and random edges by star steps alone."""
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, int(x)) for x in range(101, 160)] + [(999, int(x)) for x in range(101, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)] + [(5, 5), (100, 101)]
    want = components.union_find((a, b) for a, b in edges if a != b)
    for most in (components.FOREST_EDGES, 20):
        monkeypatch.setattr(components, "FOREST_EDGES", most)
        got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
        assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want


def test_hot_keys_join(spark):
    from tessera.llm.common import joined

    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, i) for i in range(10, 3000)], "k long, v long")
    stats = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 20")
    got = joined(rows, stats, "k", rows.count())
    assert Counter((r["k"], r["v"], r["n"]) for r in got.collect()) == Counter([(1, i, 3000) for i in range(3000)] + [(i, i, 1) for i in range(10, 3000) if i != 20])
