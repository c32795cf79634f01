import itertools
import re

from tabassay.llm.filter_audit import audit_filters, mask_cells, order_outcomes


def failing(rows):
    """(part, letters that fail, good, toxic) of every document."""
    least = {}
    for key, text, *_ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    for key, text, part, good, toxic in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (key is not None and key > least[text])
        yield part or "", fails, good, toxic


def brute(rows):
    judged, out = list(failing(rows)), {}
    for part in {r[0] for r in judged}:
        removed = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [r for r in judged if r[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                all_failing = [r for r in judged if r[0] == part and letter in r[1]]
                removed[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(all_failing) - len(gone),
                    sum(r[1] == letter for r in all_failing),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for key in out:
            if key[0] == part:
                out[key].append(removed[key[1][key[2] - 1]])
    return out


def check(found, rows):
    got = {
        (r.part, r.filter_order, r.step): [
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley,
        ]
        for r in found.collect()
    }
    assert got == brute(rows)


def labelled(docs, labels):
    judged = {}
    for key, quality, toxic in labels:
        good, bad = judged.get(key, (False, False))
        judged[key] = (good or quality == 1, bad or toxic == 1)
    judged.pop(None, None)
    return [(i, text, part, *judged.get(i, (False, False))) for i, text, part in docs]


def test_equals_brute_force(spark, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    found = audit_filters(documents, labels)
    check(found, labelled(docs, [tuple(r) for r in labels.collect()]))
    assert found.count() == 600 * len({lang for _, _, lang in docs})


def test_tricky_rows(spark, tricky, empty):
    judged = [(90, 1, 1), (91, None, 1), (92, 1, 0), (92, 0, 1), (None, 1, 1), (120, 1, None)]
    schema = "doc_id long, quality int, toxic int, part string, mask int, n long"
    labels = spark.createDataFrame([(*row, "p", 3, 4) for row in judged], schema)
    odd = [
        (200, "A B C D E", ""), (201, "a" * 9 + "B", "en"), (202, "a" * 8 + "BC", "en"),
        (203, " ".join(["w"] * 20 + [f"w{k}" for k in range(80)]), "de"),
        (204, " ".join(["w"] * 21 + [f"w{k}" for k in range(79)]), "de"), (205, "x #", None),
        (204, "\x0b\x0c a b \x1c\x85c\r\n", "fr"), (206, None, None), (7, "again", "en"),
        (8, "again", "de"), (7, "again", "de"), (9, "again", "en"), (9, "again", "en"),
    ]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    docs = tricky.unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    check(audit_filters(docs, labels), labelled(rows, judged))
    check(audit_filters(docs, labels.filter("false")), labelled(rows, []))
    assert audit_filters(empty, labels).collect() == []


def test_copies_are_counted_not_gathered(spark):
    """A text that fills most of the table, under several parts, labels and repeated ids."""
    rows = [(k % 700, "same", ["en", "de", None][k % 3]) for k in range(900)]
    labels = [(k, k % 2, k % 5 == 0) for k in range(0, 700, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    judged = spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int")
    cells = mask_cells(docs, judged)
    assert sum(r.n for r in cells.collect()) == 900
    check(audit_filters(docs, judged), labelled(rows, [(a, b, int(c)) for a, b, c in labels]))


def test_every_order_once(spark):
    rows = order_outcomes(spark).collect()
    assert len(rows) == 120 * 5 * 32 == len({(r.filter_order, r.step, r["mask"]) for r in rows})
