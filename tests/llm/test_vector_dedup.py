import numpy as np
import pytest

from tabassay.llm import vector_dedup
from tabassay.llm.queries import op8_embedding_dedup
from tabassay.llm.vector_dedup import fit, near_copies, visits


def brute(rows, threshold=0.95):
    """n_links and component of every (id, vector)."""
    sound = [
        k for k, (i, v) in enumerate(rows)
        if i is not None and v is not None and any(c for c in v if c is not None)
        and all(c is not None and np.isfinite(c) for c in v)
    ]
    parent = {k: k for k in sound}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = dict.fromkeys(range(len(rows)), 0)
    for a in sound:
        for b in sound:
            one, two = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a < b and len(one) == len(two):
                if one @ two / np.linalg.norm(one) / np.linalg.norm(two) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for k in sound:
        least[root(k)] = min(rows[k][0], least.get(root(k), rows[k][0]))
    out = []
    for k, (i, _) in enumerate(rows):
        low = least[root(k)] if k in parent else i
        out.append((i, links[k], low, None if i is None else i == low))
    return sorted(out, key=repr)


def clustered(rng, groups, each, width, noise):
    centers = rng.standard_normal((groups, width))
    rows = np.repeat(centers, each, axis=0) + noise * rng.standard_normal((groups * each, width))
    return [(int(k), v.astype(np.float32).tolist()) for k, v in enumerate(rows)]


def test_traversal_visits_in_order_all_within_bound():
    rng = np.random.default_rng(1)
    first, second = rng.random(9), rng.random(7)
    seen = visits(first, second, 0.8)
    sums = [first[i] + second[j] for i, j in seen]
    assert sums == sorted(sums)
    assert set(seen) == {(i, j) for i in range(9) for j in range(7) if first[i] + second[j] <= 0.8}


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 12, 5, 8, 0.05)
    rows += [(100 + k, rows[3][1]) for k in range(20)]
    rows += [
        (200, None), (201, [0.0] * 8), (202, [1.0, None] * 4), (203, [float("nan")] * 8),
        (204, [float("inf")] * 8), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, []),
        (None, rows[0][1]), (300, rows[0][1]), (300, rows[0][1]), (208, [1e38] * 8),
        (209, [1e-38] * 8), (210, [3.0]),
    ]
    table = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cls int, id string"
    ).repartition(3)
    found = sorted(map(tuple, near_copies(table).collect()), key=repr)
    assert found == brute(rows)
    assert near_copies(table.filter("false")).count() == 0


def test_recall_and_blocks(spark, monkeypatch):
    """Dense and loose groups, small blocks and cells, against all pairs."""
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_dedup, "BLOCK_VISITORS", 24)
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 8)
    rng = np.random.default_rng(3)
    rows = clustered(rng, 60, 6, 32, 0.2) + [
        (1000 + k, v) for k, v in clustered(rng, 1, 120, 32, 0.14)
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = {r.vec_id: r.n_links for r in near_copies(table).collect()}
    truth = {r[0]: r[1] for r in brute(rows)}
    assert sum(truth.values()) > 1000
    assert all(found[i] <= truth[i] for i in truth)
    assert sum(found.values()) >= 0.95 * sum(truth.values())


@pytest.mark.parametrize("rows", [500, 5000])
def test_margin_reaches_the_target(rows):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((rows, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = fit(x, rows, 0.95, 0.99)
    assert grid.margin > 0 and grid.cells >= rows / 128


def test_query(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    found = sorted(map(tuple, op8_embedding_dedup(spark, data).collect()), key=repr)
    assert found == brute([(r.vec_id, r.embedding) for r in table])
