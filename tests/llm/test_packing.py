import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tabassay.llm.packing import WordIds, pack, plan_best_fit, token_pieces

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def best_fit_one_by_one(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_plan_equals_best_fit_over_pieces():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 60, 400):
        for top in (3, 40, 97):
            lengths = rng.integers(1, top + 1, n)
            size, count = np.unique(lengths, return_counts=True)
            plan = plan_best_fit(dict(zip(size.tolist(), count.tolist(), strict=True)), 100)
            rank = np.concatenate([np.arange(c) for c in count]).astype(np.int64) if n else size
            length = np.repeat(size, count)
            sequence, offset = plan.place(length, rank)
            rooms = [100] * plan.sequences
            for s in range(plan.sequences):
                own = sorted(zip(offset[sequence == s], length[sequence == s], strict=True))
                at = 0
                for begin, size_ in own:
                    assert begin == at
                    at += size_
                rooms[s] -= at
            assert sorted(rooms) == best_fit_one_by_one(lengths.tolist(), 100)


def test_ids_equal_the_library(tricky):
    whole = Tokenizer.from_file(VOCABULARY)
    own = WordIds(open(VOCABULARY, encoding="utf-8").read())
    texts = [r.text or "" for r in tricky.select("text").collect()]
    texts += ["<|endoftext|> É", "it's 'll é \x1c\x85\xa0a", "ÀÉ ß× ÷", "don't", "I'LL"]
    expected = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == expected


def check(docs, capacity):
    whole = Tokenizer.from_file(VOCABULARY)
    found = pack(token_pieces(docs, VOCABULARY, capacity=capacity), capacity=capacity).collect()
    expected = []
    for row in docs.collect():
        ids = [*whole.encode(row.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at : at + capacity], dtype="<u4")
            expected.append((row.doc_id, k, at, len(own), zlib.crc32(own.tobytes())))
    key = repr
    assert sorted([tuple(r[:5]) for r in found], key=key) == sorted(expected, key=key)
    sequences = {}
    for row in found:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return found


def test_tricky_rows_are_packed_whole(tricky, empty):
    check(tricky, 64)
    check(tricky, 4096)
    assert check(empty, 4096) == []


def test_every_document(documents):
    found = check(documents, 4096)
    tokens = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= 1.05 * tokens / 4096 + 1
