import zlib
from collections import Counter

import numpy as np
import pytest

from tabassay.llm import sharding
from tabassay.llm.queries import op1_bounded_ring
from tabassay.llm.sharding import Ring, play_rows, play_steps, shard_by_ring


def check(found, docs, shards):
    rows = found.collect()
    counts = Counter(r.shard for r in rows)
    per_shard = [counts.get(k, 0) for k in range(shards)]
    assert max(per_shard) - min(per_shard) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    given = [
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
        for r in docs.collect()
    ]
    assert sorted(map(repr, given)) == sorted(repr(tuple(r)[:3]) for r in rows)
    return rows


def test_one_by_one_is_the_greedy_walk():
    rng = np.random.default_rng(1)
    ring = Ring(5, 16)
    arcs, turns = ring.arcs(rng.integers(-(2**63), 2**63, 203)), np.arange(203)
    room = np.full(5, 41)
    ends, targets = play_rows(ring, arcs, turns, room.copy())
    left = room.copy()
    for arc, turn in zip(arcs, turns, strict=True):
        shard = next(s for s in ring.onwards[arc] if left[s])
        left[shard] -= 1
        assert targets[np.searchsorted(ends, turn, "left"), arc] == shard


def test_steps_never_overfill():
    rng = np.random.default_rng(2)
    ring = Ring(8, 16)
    counts = rng.poisson(3, (128, 64))
    counts[5, 7] = 4000  # a hot id
    room = np.full(8, counts.sum() // 8)
    before = room.copy()
    plan = play_steps(ring, counts, room)
    loads = np.zeros(8, dtype=int)
    for step in range(64):
        for arc in range(128):
            if plan[step, arc] >= 0:
                loads[plan[step, arc]] += counts[arc, step]
    assert (loads <= before).all()
    assert (before - loads == room).all()


def plain_ring(rows, shards, last):
    """Shards of rows (h, first turn, later turns) as the docstring has it, row by row."""
    ring = Ring(shards, sharding.VIRTUAL_NODES)
    arcs = ring.arcs(np.array([r[0] for r in rows], dtype=np.int64))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    out, left, round_ = [None] * len(rows), list(range(len(rows))), 0
    while not round_ or len(left) > last:
        is_open = {s for s in range(shards) if room[s] > 0}
        for step in range(sharding.STEPS):
            come = [k for k in left if rows[k][1 + round_] % sharding.STEPS == step]
            while is_open:
                target = {k: next(s for s in ring.onwards[arcs[k]] if s in is_open) for k in come}
                loads = Counter(target.values())
                full = {s for s in loads if loads[s] > room[s]}
                if not full:
                    break
                is_open -= full
            if not is_open:
                break
            for k, s in target.items():
                out[k] = s
                room[s] -= 1
        left, round_ = [k for k in left if out[k] is None], round_ + 1
    for k in sorted(left, key=lambda k: rows[k][1 + round_]):
        out[k] = next(s for s in ring.onwards[arcs[k]] if room[s])
        room[out[k]] -= 1
    return out


@pytest.mark.parametrize("count,last", [(0, 20_000), (7, 20_000), (3000, 20_000), (3000, 20), (3000, 2)])
def test_equals_the_plain_ring(spark, monkeypatch, count, last):
    """One result on either side of the bound for rows that are played one by one."""
    monkeypatch.setattr(sharding, "LAST_ROWS", last)
    docs = spark.range(0, count, 1, 1).selectExpr("id * 3 AS doc_id", "'t' AS text")
    # In one partition a row's number is its place.
    turns = docs.selectExpr("*", "xxhash64(0, doc_id) AS h", "monotonically_increasing_id() AS row_id")
    later = [f"xxhash64({k}, h, row_id) AS t{k}" for k in range(1, 9)]
    rows = [tuple(r) for r in turns.selectExpr("h", "xxhash64(0, h) AS t0", *later).collect()]
    found = {r.doc_id: r.shard for r in shard_by_ring(docs).collect()}
    assert [found[3 * k] for k in range(count)] == plain_ring(rows, 8, last)


def test_tricky_rows(tricky, empty):
    check(shard_by_ring(tricky), tricky, 8)
    check(shard_by_ring(tricky, shards=3), tricky, 3)
    assert shard_by_ring(empty).count() == 0


def test_several_rounds_and_hot_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LAST_ROWS", 50)
    rows = [(None if k % 3 == 0 else k, f"text {k % 7}") for k in range(4001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(shard_by_ring(docs), docs, 8)


def test_few_rows_leave_their_first_shard(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    moved = shard_by_ring(docs).filter("shard != home").count()
    assert moved < 0.12 * 20_000
    loose = shard_by_ring(docs, load=1.5)
    assert loose.filter("shard != home").count() == 0
    assert loose.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 1.5 * 2500


def test_query(spark, data, documents):
    found = op1_bounded_ring(spark, data)
    check(found.select("doc_id", "size", "text_crc32", "shard", "slot"), documents, 8)
    assert found.select("law", "grown_shard").distinct().collect() == [("rows", None)]
