import random

import pytest

from tabassay.llm import hamming_search
from tabassay.llm.hamming_search import nearest_codes, segment_widths, sign_code
from tabassay.llm.queries import op3_topk_search


def brute(rows, queries, k):
    rows = {(i, c) for i, c in rows if i is not None and c is not None}
    out = []
    for query, asked in queries:
        if query is None or asked is None:
            continue
        found = sorted(((asked ^ c) % 2**64).bit_count() * 10**6 + i for i, c in rows if i != query)
        out += [
            (query, rank, f % 10**6, f // 10**6) for rank, f in enumerate(found[:k], 1)
        ]
    return sorted(out)


def test_equals_all_pairs_with_ties_copies_and_nulls(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    rows = [(i, base[i % 40] ^ (1 << (i % 63)) ** (i % 3 > 0)) for i in range(200)]
    rows += [(1000 + i, base[0]) for i in range(30)]
    rows += [(None, 5), (2000, None), (0, rows[0][1])]
    codes = spark.createDataFrame(rows, "vec_id long, code long").repartition(3)
    queries = codes.filter("vec_id % 25 = 0")
    asked = {tuple(r) for r in queries.collect()}
    found = sorted(map(tuple, nearest_codes(codes, queries, 5).collect()))
    assert found == brute(rows, asked, 5)
    assert nearest_codes(codes.filter("false"), queries.filter("false"), 5).count() == 0


@pytest.mark.parametrize("widths", [[32, 32], [22, 21, 21], [8] * 8])
def test_segments_change_nothing(spark, monkeypatch, widths):
    rng = random.Random(3)
    near = [rng.getrandbits(64) - 2**63 for _ in range(6)]
    rows = [(f"v{i}", near[i % 6] ^ (1 << rng.randrange(63))) for i in range(60)]
    codes = spark.createDataFrame(rows, "vec_id string, code long")
    codes = codes.selectExpr("*", "1 AS value", "2 AS segment", "3 AS rank").select("vec_id", "code")
    queries = codes.filter("vec_id IN ('v3', 'v17')")
    before = sorted(map(tuple, nearest_codes(codes, queries, 4).collect()))
    monkeypatch.setattr(hamming_search, "segment_widths", lambda n: widths)
    assert sorted(map(tuple, nearest_codes(codes, queries, 4).collect())) == before
    assert len(before) == 8


def test_widths_follow_the_number_of_codes():
    assert segment_widths(0) == segment_widths(200) == [8] * 8
    assert segment_widths(50_000) == [16] * 4 and segment_widths(2**22) == [22, 21, 21]
    assert segment_widths(10**11) == [22, 21, 21]


def test_vectors_of_any_width(spark):
    rows = [(1, [0.5, -1.0]), (2, []), (3, None), (4, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = dict(df.select("vec_id", sign_code("v")).collect())
    assert found == {1: 1, 2: None, 3: None, 4: -1}
    with pytest.raises(Exception, match="64 bits"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(sign_code("v")).collect()


def test_query_has_ten_for_each_fiftieth(spark, data):
    found = op3_topk_search(spark, data).collect()
    assert len(found) == 10 * len({r.query_id for r in found})
    assert all(r.query_id % 50 == 0 for r in found)
