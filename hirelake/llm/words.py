"""Ids of a lower-casing word-end BPE vocabulary, as its library gives them.

The vocabulary drops white space and splits a text into letter runs, single
digits and other runs before merging.  No merge crosses white space, so a text
may be encoded one white-space part at a time and each distinct part only once
per worker.  Texts are taken together, up to ``TOGETHER`` characters: Arrow splits
them at white space and numbers their distinct parts, each of which is looked up
once.  Parts that are not remembered are letter runs with ASCII punctuation
behind them, or are split by the vocabulary's own pattern; its model is asked for
each new pre-token.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hirelake.llm.common import whole_text

#: Entries a worker remembers, at most: parts and pre-tokens, in one table of both together.
REMEMBERED = (400_000, 400_000)
#: The same where workers go on to other stages and keep what they remember.
REMEMBERED_IN_STAGES = (250_000, 100_000)
#: Characters of texts whose parts are looked up together; a longer text is by itself.
TOGETHER = 1 << 20
#: Behind a letter run, what is one pre-token of its own; an apostrophe may not be.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space to Python but not to the vocabulary's pattern.
CONTROLS = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordIds:
    """Encodes texts to little-endian unsigned 16-bit ids."""

    def __init__(self, path: str, remembered: tuple[int, int] = REMEMBERED):
        self.most = sum(remembered)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are ordinary text
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [x["type"] for x in rules["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or len(rules["model"]["vocab"]) > 1 << 16:
            raise ValueError(f"{path}: not a lower-casing word vocabulary of 16-bit ids")
        self.model = self.library.model
        self.split = regex.compile(split)
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        every = np.arange(1 << 16, dtype="<u2").tobytes()
        self.two_bytes = [every[n : n + 2] for n in range(0, len(every), 2)]
        self.run = regex.compile(r"\p{L}+").fullmatch
        self.known: dict[str, bytes] = {}

    def _pre_token(self, token: str) -> bytes:
        value = self.known.get(token)
        if value is None:
            letters = token
            if not (token.isascii() and token.isprintable()):  # these stand for themselves
                letters = token.encode().decode("latin-1").translate(self.letters)
            value = b"".join([self.two_bytes[t.id] for t in self.model.tokenize(letters)])
            if len(self.known) < self.most:
                self.known[token] = value
        return value

    def _part(self, part: str) -> bytes:
        value = self.known.get(part)
        if value is None:
            run = part.rstrip(PUNCTUATION)
            if run.isalpha() and (run.isascii() or self.run(run)):
                # Two pre-tokens at most; the part is not remembered beside them.
                value = self._pre_token(run)
                if len(run) < len(part):
                    value += self._pre_token(part[len(run) :])
            else:
                value = b"".join(map(self._pre_token, self.split.findall(part)))
                if len(self.known) < self.most:
                    self.known[part] = value
        return value

    def whole(self, text: str) -> bytes:
        """By the library, the text as one."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _lowered(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # the library lowers each character by itself
            text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> bytes:
        if any(c in text for c in CONTROLS):
            return self.whole(text)
        return b"".join(map(self._part, self._lowered(text).split()))

    def encode_all(self, texts: list[str], end_id: int) -> pa.Array:
        """The ids of each text and ``end_id`` behind them, as binary."""
        apart = {n for n, text in enumerate(texts) if any(c in text for c in CONTROLS)}
        lowered = ["" if n in apart else self._lowered(text) for n, text in enumerate(texts)]
        split = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
        parts = split.flatten().dictionary_encode()
        values = list(map(self._part, parts.dictionary.to_numpy(zero_copy_only=False)))
        stored = np.frombuffer(b"".join(values), "<u2")
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 2
        starts = np.cumsum(lengths) - lengths
        # Ids before each part, and before each text.
        at = parts.indices.to_numpy()
        before = np.concatenate([[0], np.cumsum(lengths[at])])
        places = np.repeat(starts[at] - before[:-1], lengths[at]) + np.arange(before[-1])
        edges = before[split.offsets.to_numpy()]
        ids = np.insert(stored[places], edges[1:], np.uint16(end_id)).astype("<u2", copy=False)
        offsets = 2 * (edges + np.arange(len(edges)))
        rows = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]
        ).cast(pa.binary())
        if not apart:
            return rows
        end = np.array([end_id], "<u2").tobytes()
        told = rows.to_pylist()
        for n in apart:
            told[n] = self.whole(texts[n]) + end
        return pa.array(told, pa.binary())


_KNOWN: dict[tuple, WordIds] = {}


def word_ids(path: str, remembered: tuple[int, int] = REMEMBERED) -> WordIds:
    """One encoder per worker process, vocabulary and size of memory."""
    if (path, remembered) not in _KNOWN:
        _KNOWN[path, remembered] = WordIds(path, remembered)
    return _KNOWN[path, remembered]


def encode_words(
    documents: DataFrame,
    path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    remembered: tuple[int, int] = REMEMBERED,
) -> DataFrame:
    """``key`` and ``ids``: little-endian unsigned 16-bit, with ``end_id`` behind each text.

    Null and empty texts are the end id alone; other columns are left behind.
    """

    def run(batches):
        own = word_ids(path, remembered)
        keys, texts, size = [], [], 0

        def flush():
            nonlocal keys, texts, size
            columns = [pa.concat_arrays(keys), own.encode_all(texts, end_id)]
            keys, texts, size = [], [], 0
            return pa.RecordBatch.from_arrays(columns, [key, "ids"])

        for batch in batches:
            first = 0
            rows = batch.column(1).to_pylist()
            for n, text in enumerate(rows):
                if texts and size + len(text) > TOGETHER:
                    if n > first:
                        keys.append(batch.column(0).slice(first, n - first))
                    first = n
                    yield flush()
                texts.append(text)
                size += len(text) + 1
            if len(rows) > first:
                keys.append(batch.column(0).slice(first))
        if texts:
            yield flush()

    source = documents.select(F.col(key).alias(key), whole_text(text).alias("text"))
    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, ids binary")
