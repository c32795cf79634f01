import itertools
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_jaccard_join import LOWER
from tokenizers import Tokenizer

import corpus_pipeline
from tabassay.llm.secret_scan import masked


def kept_texts(rows):
    """What packing gets: one lettered document of each component, secrets masked."""
    rows = [(i, t) for i, t in rows if any(map(str.isalpha, t or ""))]
    low = near_copies_of(rows)
    return {i: masked(t) for i, t in rows if low[i] == i}


def test_run_equals_brute_force(spark, data, documents):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, text in kept_texts([(r.doc_id, r.text) for r in documents.collect()]).items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            expected.append((i, k, at, len(own), zlib.crc32(own.tobytes())))
    found = corpus_pipeline.run(spark, data).collect()
    assert sorted(tuple(r[:5]) for r in found) == sorted(expected)


def test_stages_keep_the_columns(spark, tricky, empty):
    for docs in (tricky, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, None).cache()
            assert docs.columns == tricky.columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, None)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in last.select("doc_id").collect()} == ids


def near_copies_of(rows):
    """Least id reachable by five-word shingle similarities of 0.8 or more, for every id."""
    sets, low = {}, {i: i for i, _ in rows}
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def test_near_duplicates_equal_brute_force(spark, documents):
    docs = documents.filter(F.col("text").rlike(r"\p{L}"))
    low = near_copies_of([(r.doc_id, r.text) for r in docs.collect()])
    kept = corpus_pipeline.one_of_each(spark, docs, None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in low if low[i] == i)


def test_unique_text_of_a_repeated_id_stays(spark):
    rows = [
        (1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text that is unique"),
        (2, "quite another text that is unique"), (3, None), (3, ""), (3, ""), (None, "a b c d e f"),
        (None, "a b c d e f"), (4, "A b c d e f"), (4, "g h i j k l"), (5, "G h i j k l"),
        (5, "g h i j k L"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(tuple, corpus_pipeline.one_of_each(spark, docs, None).collect()), key=str)
    expected = [rows[k] for k in (0, 2, 4, 5, 7, 8, 10)]
    assert kept == sorted(expected, key=str)


def test_near_copies_go(spark):
    """Copies of a five-word similarity of 0.815 and 0.817, of a three-word one of 0.886."""
    rows = []
    for words, edits in ((200, 4), (500, 10)):
        text = [f"w{words}x{k}" for k in range(words)]
        rows.append((words, " ".join(text)))
        for k in range(edits):
            text[20 + k * 45] = f"edit{k}"
        rows.append((words + 1, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_each(spark, docs, None)
    assert sorted(r.doc_id for r in kept.collect()) == [200, 500]


def test_documents_without_any_label_stay(spark):
    rows = [(0, "some words", None), (1, "12 ...", None), (2, None, None), (3, "中文字 é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.known_language(spark, docs, None)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3]
