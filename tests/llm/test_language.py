import itertools
import zlib

import numpy as np

from tabassay.llm.language import best_path, held_out, identify, learn
from tabassay.llm.queries import op5_language_id


def slow_path(scores, penalty):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[k, label] for k, label in enumerate(path))
        value -= penalty * sum(a != b for a, b in itertools.pairwise(path))
        if best is None or value > best:
            best = value
    return best


def test_path_is_the_best_one():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 5, 1, 7, 3, 0, 6])
    scores = -rng.exponential(2.0, (sizes.sum(), 3)).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    labels = best_path(scores, starts, sizes, 1.5)
    for start, size in zip(starts, sizes, strict=True):
        own, path = scores[start : start + size], labels[start : start + size]
        value = sum(own[k, label] for k, label in enumerate(path))
        value -= 1.5 * sum(a != b for a, b in itertools.pairwise(path.tolist()))
        assert size == 0 or abs(value - slow_path(own, 1.5)) < 1e-4


def test_held_out_rows(spark):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    found = {r.doc_id: r.h for r in rows.select("doc_id", held_out().alias("h")).collect()}
    assert found == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in range(100)}


def test_mixed_text_and_scripts(spark, tricky):
    model = learn(tricky)
    assert model.languages == ["de", "en", "fr"]
    english, german = "the river and house from morning ", "straße und der fluss über haus "
    rows = [(1, english * 3 + german * 4), (2, "123 ..."), (3, None), (4, "中文字" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = docs.select("doc_id", identify(docs, model, with_spans=True).alias("f")).collect()
    found = {r.doc_id: r.f for r in found}
    assert found[1].lang == "de" and 0.5 < found[1].score < 0.7
    assert found[1].langs == ["en", "de"]
    assert rows[0][1][found[1].starts[1] :].startswith("straße")
    assert (found[2].lang, found[2].score, found[2].langs) == ("und", 0.0, [])
    assert found[3].lang == "und"
    assert found[4].lang in model.languages


def test_nothing_learned(tricky, empty):
    model = learn(empty)
    assert model.languages == []
    found = tricky.select(identify(tricky, model)["lang"].alias("l")).distinct().collect()
    assert found == [("und",)]
    assert empty.select(identify(empty, learn(tricky))).count() == 0


def test_query_on_held_out_documents(spark, data, documents):
    found = {r.doc_id: r for r in op5_language_id(spark, data).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert set(found) == set(truth)
    out = [i for i in truth if found[i].held_out]
    assert out and sum(found[i].lang_pred == truth[i] for i in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in found.values())
