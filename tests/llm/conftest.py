import random

import pytest

LANGS = {
    "en": "the of and that with from house river under green walked slowly because morning".split(),
    "de": "der und nicht mit straße über grün langsam weil morgen haus fluss schön wäre".split(),
    "fr": "le et que avec maison rivière sous verte lentement parce matin était où été".split(),
}


def prose(rng, lang, words):
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(words))


def tricky_rows():
    """(doc_id, text, lang): nulls, empty and long texts, ties, near and exact copies."""
    rng = random.Random(5)
    rows, base = [], {}
    for k in range(60):
        lang = ["en", "de", "fr"][k % 3]
        base[k] = prose(rng, lang, rng.randint(1, 120))
        rows.append((k, base[k], lang))
    for k in range(60, 90):  # near copies of one text
        words = base[0].split() + ["tail"] * 3
        words[rng.randrange(len(words))] = f"word{k}"
        rows.append((k, " ".join(words), "en"))
    rows += [(k, base[1], "de") for k in range(90, 120)]  # exact copies
    rows += [
        (120, None, "en"), (121, "", "en"), (122, " \n\t ", None), (123, "1234 ... 5678", None),
        (None, "a text without an id", "en"), (None, None, None), (125, base[2], None),
        (126, prose(rng, "en", 30_000), "en"), (127, "x", None), (127, "x", None), (127, "y z", None),
        (128, "İstanbul ſecret=K Kelvin ß ÿ 中文字 emoji 😀 ﬁ", "de"), (129, "中文字" * 40, None),
        (-5, "a b c", "en"), (130, "A  b\tC", "en"), (131, "a b c d", "en"),
    ]
    return rows


#: Columns whose names the operators use inside.
CLASHES = "shard int, slot int, id string, cls string, size int, place int, spans string, n int"


@pytest.fixture(scope="session")
def tricky(spark):
    """The tricky rows with clashing columns, in several partitions."""
    made = [(*row, "src", 1, *[None] * 8) for row in tricky_rows()]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    return spark.createDataFrame(made, schema).repartition(5, "doc_id").cache()


@pytest.fixture(scope="session")
def empty(tricky):
    return tricky.filter("doc_id > 1000000")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
