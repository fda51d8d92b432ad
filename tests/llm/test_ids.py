"""Word ids, their files and their packing."""

import itertools
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from hirelake.llm import packing, rans, words
from hirelake.llm.common import landed

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_as_the_library():
    own, rng = words.word_ids(PATH), random.Random(2)
    letters = "  \n\t\x1c\x85\xa0​ ab'sST'll1½²ñΣΑσİ漢🙂$.é́é<|endoftext|>ßẞÅ"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert own.encode(text) == own.whole(text)


def _library_ids(text, end):
    ids = np.frombuffer(words.word_ids(PATH).whole(text or ""), "<u2")
    return np.append(ids, np.uint16(end))


def test_letter_runs_are_not_split():
    text = "Plain letters Only ofthwheaor"
    ids = words.WordIds(PATH, (0, 0))
    ids.split = None
    assert ids.encode(text) == ids.whole(text)


def test_texts_together_as_one_by_one():
    rng = random.Random(4)
    letters = "  \n\x00\x7f\x1c\x85\u180e\u200b ab's-.,ST'll1½²ñΣσİ漢🙂$é́é<|endoftext|>ßẞÅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    own = words.WordIds(PATH)
    expected = [_library_ids(x, 2).astype("<u2").tobytes() for x in texts]
    for step in (1, 7, 2000):
        found = [own.encode_all(texts[n : n + step], 2).to_pylist() for n in range(0, len(texts), step)]
        assert list(itertools.chain(*found)) == expected
    assert [own.encode(x) + b"\2\0" for x in texts] == expected
    assert own.encode_all([], 2).to_pylist() == []


def test_a_part_is_looked_up_once_for_all_texts():
    own = words.WordIds(PATH, (0, 0))
    asked, tokenize = [], own.model.tokenize

    class Model:
        def tokenize(self, letters):
            asked.append(letters)
            return tokenize(letters)

    own.model, own.split = Model(), None
    texts = ["Ofthwheaor ofthwheaor, nägeté."] * 50
    assert own.encode_all(texts, 2).to_pylist() == [own.whole(texts[0]) + b"\2\0"] * 50
    # The run, the run with its comma, and the third with its stop.
    assert len(asked) == 5


def test_white_space_of_arrow_is_that_of_python():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    split = pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in chars]))
    parts = pc.list_value_length(split).to_numpy()
    assert [c for c, n in zip(chars, parts) if (n == 2) != c.isspace()] == []


def test_rows_keep_their_ids_over_many_takes(spark, odd_documents):
    rows = [(n, f"{n} word " * 40_000 if n % 3 else f"short {n}") for n in range(100, 145)]
    frame = odd_documents(*rows).coalesce(1)
    assert sum(len(text) for _, text in rows) > 2 * words.TOGETHER
    found = words.encode_words(frame, PATH, 2).collect()
    own = words.word_ids(PATH)
    expected = [(r.doc_id, own.encode(r.text or "") + b"\2\0") for r in frame.collect()]
    assert [(r.doc_id, bytes(r.ids)) for r in found] == expected


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 70_000) % 5000).astype(np.uint16)
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=rans.ALPHABET)))
    for n in (0, 1, 1023, 1024, 1025, 70_000):
        state, coded = coder.encode(ids[:n])
        assert (coder.decode(n, state, coded) == ids[:n]).all()
    # The size is near the entropy.
    p = np.bincount(ids) / len(ids)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids)
    _, coded = coder.encode(ids)
    assert 32 * len(coded) < bits * 1.02 + 1000


def test_frequencies():
    counts = np.zeros(rans.ALPHABET, np.int64)
    assert rans.scaled(counts).sum() == 0
    counts[:] = 1
    counts[7] = 10**12
    frequency = rans.scaled(counts)
    assert frequency.sum() == 1 << rans.PRECISION and frequency.min() == 1


def test_files(spark, odd_documents, monkeypatch):
    frame = odd_documents((8, "short"), (0, "first of all"))
    encoded = landed(words.encode_words(frame, PATH, 2), "ids")
    archive = rans.write_ids(encoded)
    rows = frame.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id))
    expected, start = [], 0
    for r in rows:
        ids = _library_ids(r.text, 2)
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    found = rans.read_digests(archive).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    whole = {r.doc_id: bytes(r.ids) for r in rans.read_ids(archive).collect()}
    assert all(np.array_equal(np.frombuffer(whole[r.doc_id], "<u2"), _library_ids(r.text, 2)) for r in rows)


def test_document_of_many_blocks(spark):
    long = np.arange(rans.BLOCK * 2 + 5, dtype=np.uint32) % 700
    rows = [(1, np.arange(3).astype("<u2").tobytes()), (2, long.astype("<u2").tobytes()), (3, b"")]
    encoded = landed(spark.createDataFrame(rows, "doc_id bigint, ids binary"), "ids")
    archive = rans.write_ids(encoded)
    assert archive.checkpoints.agg({"blocks": "max"}).first()[0] == 3
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.read_digests(archive).collect()}
    assert found == {
        1: (0, 3, zlib.crc32(np.arange(3).astype("<u4").tobytes())),
        2: (3, len(long), zlib.crc32(long.astype("<u4").tobytes())),
        3: (3 + len(long), 0, 0),
    }


def test_damage_is_found(spark):
    encoded = landed(
        spark.createDataFrame([(1, np.arange(500).astype("<u2").tobytes())], "doc_id bigint, ids binary"), "ids"
    )
    archive = rans.write_ids(encoded)
    place = archive.checkpoints.first()
    path = f"{archive.folder}/{place.file}"
    with open(path, "r+b") as file:
        file.seek(place["at"] + rans.HEADER.size + 40)
        byte = file.read(1)
        file.seek(-1, 1)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        rans.read_digests(archive).collect()


def test_no_ids(spark, odd_documents):
    encoded = landed(words.encode_words(odd_documents().limit(0), PATH, 2), "ids")
    assert rans.read_digests(rans.write_ids(encoded)).count() == 0
    assert packing.pack_documents(encoded).count() == 0


def _fewest(sizes, length):
    """By trying all partitions."""
    best = [len(sizes)]

    def go(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= sizes[at]:
                go(at + 1, rooms[:i] + [room - sizes[at]] + rooms[i + 1 :])
        go(at + 1, rooms + [length - sizes[at]])

    go(0, [])
    return best[0]


def test_packing_small_sets_best():
    rng = random.Random(8)
    worse = 0
    for _ in range(150):
        sizes = [rng.randint(2, 18) for _ in range(rng.randint(1, 8))]
        packed = packing.pack_sizes(sizes, 20)
        assert sorted(itertools.chain(*packed)) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in s) <= 20 for s in packed)
        worse += len(packed) > _fewest(sizes, 20)
    assert worse == 0


def test_branch_and_bound_beats_best_fit():
    rng = random.Random(3)
    sizes = [rng.randint(1000, 1700) for _ in range(200)]
    assert len(packing.pack_sizes(sizes, 4096)) < len(packing.best_fit(sizes, 4096))


def test_search_counts_in_plain_integers():
    left = packing._Left([3, 3, 5, 9], 20)
    assert {type(n) for n in left.count} == {int}
    before = list(left.count)
    assert packing.fillings(left, 11) == [(5, 3, 3), (3, 5, 3), (9,)]
    assert left.count == before


def test_packed_rows(spark, odd_documents):
    frame = odd_documents(*((n, "some words " * (n % 90)) for n in range(100, 900)))
    encoded = landed(words.encode_words(frame, PATH, 1), "ids")
    rows = packing.pack(landed(packing.pieces(encoded), "pieces"), group=100).toPandas()
    by_document = rows[rows.doc_id == 5].sort_values("piece")
    assert list(by_document.piece) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert list(by_document.start) == [4096 * n for n in range(8)]
    assert rows.length.sum() == sum(len(_library_ids(r.text, 1)) for r in frame.select("text").collect())
    for _, placed in rows.sort_values("offset").groupby("sequence_id"):
        assert list(placed.offset) == [0, *placed.length.cumsum()[:-1]]
        assert placed.length.sum() <= 4096
    unique = landed(encoded.filter("doc_id >= 100"), "ids")
    placed = landed(packing.pack_documents(unique), "packed")
    sequences = packing.sequences(unique, placed).collect()
    assert sum(len(r["ids"]) for r in sequences) == 2 * placed.agg({"length": "sum"}).first()[0]


READER = """
import sys
from hirelake.session import build_session
from hirelake.llm import rans
spark = build_session("reader", **{"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.driver.memory": "1g"})
rows = rans.read_ids(rans.open_archive(spark, sys.argv[1])).collect()
print("READ", sorted((r.doc_id, bytes(r.ids).hex()) for r in rows))
"""


def test_archives_are_read_by_another_process(spark, tmp_path):
    rows = [(n, np.arange(n * 7).astype("<u2").tobytes()) for n in range(1, 20)]
    encoded = landed(spark.createDataFrame(rows, "doc_id bigint, ids binary"), "ids")
    folder = str(tmp_path / "archive")
    rans.write_ids(encoded, folder=folder)
    told = subprocess.run(
        [sys.executable, "-c", READER, folder], capture_output=True, text=True, timeout=200, cwd=Path(__file__).parents[2]
    )
    line = next(x for x in told.stdout.splitlines() if x.startswith("READ "))
    assert line == "READ " + str([(k, data.hex()) for k, data in rows])
    # A table that does not match its checksum is refused.
    table = spark.read.parquet(f"{folder}/table").collect()
    broken = [(bytearray(b"\1" + bytes(table[0].frequencies)[1:]), table[0].crc32)]
    spark.createDataFrame(broken, "frequencies binary, crc32 bigint").write.mode("overwrite").parquet(f"{folder}/table")
    with pytest.raises(ValueError, match="damaged"):
        rans.open_archive(spark, folder)
