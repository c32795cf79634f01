import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tabassay.llm.byte_bpe import ByteBpe, PerfectHash, decode, encode, read_ranks
from tabassay.llm.queries import op9_byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as file:
        return ByteBpe(read_ranks(file.read()), public_tokenizers.PATTERN)


def test_perfect_hash_numbers_all_keys():
    keys = [str(k * k).encode() for k in range(5000)]
    assert sorted(PerfectHash(keys).numbers(keys)) == list(range(5000))
    assert PerfectHash([]).numbers([b"a"]).tolist() == [-1]


def test_random_texts_equal_the_library(library, coder):
    rng = random.Random(3)
    letters = "aabcde  '\n\t\r\x1c\x85\xa0 　é中1٣Ⅷ½.,!'srevelß́😀_-\x0b\x00Σς"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(4000)]
    texts += ["a" * 3000, " " * 50 + "x", "it's we'll", "<|endoftext|>", ""]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


def test_tables_round_trip(tricky, empty, library):
    coded = encode(tricky, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "ids"]
    both = decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    expected = sorted((r.text or "").encode() for r in tricky.collect())
    assert sorted(bytes(r.decoded) for r in both) == expected
    assert encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_digests(spark, data, documents, library):
    found = {r.doc_id: r for r in op9_byte_bpe(spark, data).collect()}
    for row in documents.collect():
        ids = library.encode_ordinary(row.text)
        listed = " ".join(map(str, ids)).encode()
        one = found[row.doc_id]
        assert one.n_tokens == len(ids)
        assert one.ids_sha256 == hashlib.sha256(listed).hexdigest()
        assert one.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()
