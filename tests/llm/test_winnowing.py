import random

import pytest
from test_license_scan import LOWER, WORD

from tabassay.llm.winnowing import contamination, hash_bitmap


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window=10):
    out = []
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for k in range(len(words) - n + 1) if n else ():
            windows.setdefault((n, *words[k : k + n]), set()).add(item)
    sizes = {w[0] for w in windows}
    for key, text in rows:
        words, hit, found = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (own := (n, *words[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[own]
        listed = tuple(sorted(str(i) for i in found if i is not None))
        out.append((key, len(words), len(hit), listed))
    return out


def check(found, rows, items, window=10):
    found = found.collect()
    for r in found:
        assert len({w for s in r.spans for w in range(s.start, s.end)}) == r.n_hit
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(brute(rows, items, window), key=order)


def test_equals_brute_force(spark, documents, data):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    check(contamination(documents, benchmark), rows, items)
    assert any(hit for _, _, hit, _ in brute(rows, items))


@pytest.mark.parametrize("seed", range(3))
def test_few_words_repeat_everywhere(spark, seed):
    """Texts of three words: windows overlap, repeat and hold equal least hashes."""
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows = [(k, some(rng.randint(0, 60))) for k in range(60)]
    items = [(k % 25, some(rng.choice([0, 4, 5, 9, 10, 11, 14, 30]))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    check(contamination(docs, benchmark), rows, items)


def test_tricky_rows(spark, tricky, empty):
    items = [
        (1, "x"), (1, "der und nicht"), (2, None), (3, "!!"), (None, "a B-c"), (4, "a, b. c D"),
        (5, "中文字" * 40), (6, "i̇stanbul"), (7, tricky.filter("doc_id = 0").first().text),
        (8, tricky.filter("doc_id = 0").first().text.upper()),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clashing = benchmark.selectExpr("*", "1 as hash", "2 as row", "3 as words_key", "4 as prints")
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    check(contamination(tricky, clashing), rows, items)
    check(contamination(tricky, clashing.filter("item_id > 100")), rows, [])
    assert contamination(empty, benchmark).collect() == []


def test_other_window_names_and_item_ids(spark):
    rows = [(k, f"p{k} q r s t u v w x y z") for k in range(4)]
    items = [("b", "q r s t u v"), ("a", "u v w x"), ("a", "z q")]
    docs = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, body string")
    benchmark = spark.createDataFrame(items, "name string, body string")
    found = contamination(docs, benchmark, "doc_id", "body", "name", "body", window=4, gram=2)
    check(found, rows, items, window=4)


def test_bitmap_holds_every_hash(spark):
    hashes = [0, 1, 9, -1, 2**24, 2**24 + 32768, -(2**40) + 77, 2**63 - 1]
    found = hash_bitmap(spark.createDataFrame([(h,) for h in hashes], "hash long"))
    bits = {h % 2**24 for h in hashes}
    assert len(found) == 2**21
    assert {8 * k + b for k, x in enumerate(found) if x for b in range(8) if x >> b & 1} == bits
