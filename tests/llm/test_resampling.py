import hashlib
import random
import zlib
from collections import Counter
from math import floor, log

import pytest
from test_license_scan import LOWER, WORD

from tabassay.llm.resampling import crc32_of, resample


def buckets(text):
    words = WORD.findall((text or "").translate(LOWER))
    features = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in features]


def brute(rows, targets):
    """(id, n_features, weight, score) of every row and the drawn ids in order."""
    source, target = Counter(), Counter()
    for _, text in rows:
        source.update(buckets(text)[1])
    for text in targets:
        target.update(buckets(text)[1])
    s_all, t_all = sum(source.values()) + 10_000, sum(target.values()) + 10_000
    out, known = [], []
    for key, text in rows:
        n_words, own = buckets(text)
        gains = [floor(1000 * log((target[b] + 1) * s_all / ((source[b] + 1) * t_all))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))
        out.append((key, len(own), weight, score))
        if n_words >= 20:
            known.append((-score, key is not None, key or 0))
    return out, [x[2] for x in sorted(known)[: 25 * len(known) // 100]]


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def check(found, rows, targets):
    expected, drawn = brute(rows, targets)
    found = found.collect()
    got = [(r.doc_id, r.n_features, r.weight, r.score) for r in found]
    assert plain(got) == plain(expected)
    ranked = sorted((r.rank, r.doc_id) for r in found if r["rank"] is not None)
    assert ranked == list(enumerate(drawn, 1))


@pytest.mark.parametrize("count", [0, 1, 500])
def test_checksums_of_all_lengths(count):
    rng = random.Random(count)
    items = [rng.randbytes(rng.choice([0, 1, 2, 7, 7, 300])) for _ in range(count)]
    assert crc32_of(items).tolist() == [zlib.crc32(x) for x in items]


def test_equals_brute_force(spark, documents, data):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(resample(documents, benchmark), rows, [r.text for r in benchmark.collect()])


def test_tricky_rows(spark, tricky, empty):
    targets = ["house river green", None, "", "Haus, Straße; der und 中文字"]
    benchmark = spark.createDataFrame([(t, t) for t in targets], "text string, rank string")
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    check(resample(tricky, benchmark), rows, targets)
    check(resample(tricky, benchmark.filter("false")), rows, [])
    assert resample(empty, benchmark).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    """Copies of one text and id: equal scores, ranks without gaps."""
    text = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(k // 4, text) for k in range(40)], "doc_id long, text string")
    found = resample(docs.repartition(7), docs).filter("rank is not null")
    best = sorted(brute([(k, text) for k in range(10)], [text] * 40)[0], key=lambda r: -r[3])
    expected = [i for i, *_ in best for _ in range(4)][:10]
    assert [r.doc_id for r in found.orderBy("rank").collect()] == expected


def test_text_ids_and_other_names(spark):
    docs = spark.createDataFrame([(f"k{k}", "a b c " * k) for k in range(9)], "key string, body string")
    found = resample(docs, docs, "key", "body", "body", min_words=1, percent=50)
    assert sorted(r["rank"] for r in found.filter("rank is not null").collect()) == [1, 2, 3, 4]
