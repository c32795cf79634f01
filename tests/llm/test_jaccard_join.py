import random
import re

import numpy as np

from tabassay.llm import components as components_of
from tabassay.llm import jaccard_join
from tabassay.llm.components import components
from tabassay.llm.jaccard_join import (
    CountTree, cells_of, keep_one_of_each, most_apart, overlap_needed, point_of, read_points,
    similar_components,
)
from tabassay.llm.queries import op4_jaccard_join

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    return frozenset(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows):
    """Component of every (id, text) with an id, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            one, two = sets[a][1], sets[b][1]
            if one and two and 9 * len(one) <= 10 * len(two) and 9 * len(two) <= 10 * len(one):
                common = len(one & two)
                if 100 * common >= 90 * (len(one) + len(two) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def check(found, docs):
    rows = found.collect()
    assert len(rows) == docs.count()
    own = sorted(tuple(r) for r in rows if r[0] is not None)
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert own == expected
    assert all(r[2] is None for r in rows if r[0] is None)


def linked_sets(rng):
    n = int(rng.choice([9, 10, 11, 13, 17, 18, 30, 100, 300, 1000]))
    apart = most_apart(n)
    one = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    more = int(rng.integers(0, apart + 1))
    less = int(rng.integers(0, apart - more + 1))
    two = np.concatenate(
        [one[rng.permutation(n)[less:]], rng.integers(0, 2**64, more, dtype=np.uint64)]
    )
    return one, np.unique(two)


def test_linked_sets_share_a_cell_and_pass_the_bound():
    rng, linked = np.random.default_rng(1), 0
    for _ in range(2000):
        one, two = linked_sets(rng)
        common = len(np.intersect1d(one, two))
        if 100 * common >= 90 * (len(one) + len(two) - common):
            linked += 1
            assert set(cells_of(one).tolist()) & set(cells_of(two).tolist())
            p, q = read_points([point_of(one), point_of(two)])
            assert np.minimum(p, q).sum(dtype=int) >= overlap_needed(len(one), len(two))
            assert overlap_needed(len(one), len(two)) <= common
    assert linked > 1000


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(2)
    for rows in (1, 31, 33, 700):
        points = rng.poisson(0.5, (rows, 512)).astype(np.uint8)
        points[::5] = points[0]
        points[::5, 3] += rng.integers(0, 9, len(points[::5])).astype(np.uint8)
        sizes = points.sum(axis=1).astype(np.int64)
        query, at = CountTree(points, sizes).near(points[:50], sizes[:50])
        assert set(zip(query.tolist(), at.tolist(), strict=True)) == {
            (i, j)
            for i in range(min(50, rows))
            for j in range(rows)
            if np.minimum(points[i], points[j]).sum(dtype=int)
            >= overlap_needed(sizes[i], sizes[j])
        }


def test_tricky_rows(tricky, empty):
    check(similar_components(tricky), tricky)
    assert similar_components(empty).count() == 0


def test_chain_and_large_cells(spark, monkeypatch):
    """Near copies that are linked in chains only, in cells of several blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(90)]
    rows, text = [], list(words)
    for k in range(250):
        if k % 3 == 0:
            text = list(text)
            text[rng.randrange(len(text))] = f"n{k}"
        one = list(text)
        if k % 2:
            one[rng.randrange(len(one))] = f"x{k}"
            one[rng.randrange(len(one))] = f"y{k}"
        rows.append((1000 - k, " ".join(one)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(similar_components(docs), docs)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (21, 20), (5, 5), (None, 4)]
    links += [(100 + k, 101 + k) for k in range(40)]
    found = components(spark.createDataFrame(links, "x long, y long"))
    expected = {k: 1 for k in (1, 2, 3, 7, 8, 9)} | {20: 20, 21: 20}
    assert dict(map(tuple, found.collect())) == expected | {k: 100 for k in range(100, 141)}


def test_one_of_each_stays(tricky):
    kept = keep_one_of_each(tricky)
    assert kept.columns == tricky.columns
    texts = {(r.doc_id, r.text) for r in tricky.collect() if r.doc_id is not None}
    component = {}
    for i, _, low in brute([(i, t) for i, t in texts]):
        component.setdefault(i, set()).add(low)
    expected = sorted((i, t or "") for i, t in texts if i in component[i])
    assert sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None) == expected
    assert kept.filter("doc_id IS NULL").count() == 2


def test_query(spark, data, documents):
    check(op4_jaccard_join(spark, data), documents)


def test_few_rows_pass_that_are_not_wanted(spark):
    """A hundred thousand wanted keys among half a million let hardly any other pass."""
    rows = spark.range(500_000)
    passed = jaccard_join._thinned(rows, spark.range(100_000), "id")
    assert passed.columns == ["id"]
    assert passed.filter("id < 100000").count() == 100_000
    assert passed.filter("id >= 100000").count() < 10_000


def test_least_class_of_a_cell_is_not_searched_again(spark, monkeypatch):
    """Unlinked texts that share cells: the least of three was held against both others."""
    asked, search = [], jaccard_join._near_pairs

    def counted(rows, percent):
        asked.extend(r["count"] for r in rows.groupBy("cell").count().collect())
        return search(rows, percent)

    monkeypatch.setattr(jaccard_join, "_near_pairs", counted)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(3):
        one = list(words)
        for at in range(3):
            one[10 + 60 * at + 20 * k] = f"edit{k}"
        rows.append((k, " ".join(one)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(similar_components(docs), docs)
    assert asked and set(asked) == {2}


def test_few_links_lie_in_few_tasks(spark, monkeypatch):
    """Every round is cut in a few partitions, however many a shuffle has."""
    cuts, cut = [], components_of.cut

    def counted(df):
        out = cut(df)
        cuts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components_of, "cut", counted)
    settings = {"shuffle.partitions": "40", "adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(f"spark.sql.{name}") for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(f"spark.sql.{name}", value)
        links = spark.createDataFrame([(k, k + 1) for k in range(30)], "x long, y long")
        assert {r.component for r in components(links).collect()} == {0}
    finally:
        for name, value in before.items():
            spark.conf.set(f"spark.sql.{name}", value)
    assert len(cuts) > 2 and max(cuts[1:]) <= components_of.LEAST_TASKS
