import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from hirelake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(library):
    own, rng = bpe.codec(PATH, PATTERN), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("  \n\t\x1c\x85　 ab'sté1½²ñΣ漢🙂$.") for _ in range(rng.randint(0, 40)))
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_long_pre_tokens(library):
    own = bpe.codec(PATH, PATTERN)
    for text in ("aab" * 2000, "x" * 5000, "the" * 3000 + "é" * 500):
        assert own.encode(text) == library.encode_ordinary(text)


def test_lower_ranks_that_a_merge_makes():
    # "bc" merges last, yet "abc" has a rank below it.
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"bc": 4, b"abcabc": 5}
    own = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for piece in ("abcabcab", "aabcbc", "cabc", "abcabcabcabc"):
        expected = own.encode_ordinary(piece)
        assert bpe.merge(piece.encode(), ranks) == expected


def test_rows(spark, odd_documents, documents, library):
    for frame in (odd_documents(), documents):
        found = bpe.encode_and_decode(frame, PATH, PATTERN)
        assert found.columns == ["doc_id", "ids", "decoded"]
        told = sorted(((r.doc_id or -1, tuple(r.ids), bytes(r.decoded)) for r in found.collect()))
        texts = [(r.doc_id or -1, r.text or "") for r in frame.select("doc_id", "text").collect()]
        assert told == sorted((k, tuple(library.encode_ordinary(t)), t.encode()) for k, t in texts)
    encoded = bpe.encode_texts(odd_documents(), PATH, PATTERN)
    again = bpe.decode_ids(encoded, PATH, PATTERN).filter("doc_id = 7").first()
    assert hashlib.sha256(again.decoded).digest() == hashlib.sha256("12 + 34 = 46 !!! 漢字 🙂 naïve Straße".encode()).digest()


def test_no_rows(odd_documents):
    assert bpe.encode_and_decode(odd_documents().limit(0), PATH, PATTERN).count() == 0
