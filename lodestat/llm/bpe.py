"""Encoding with a public byte-level BPE vocabulary.

Text is split by the vocabulary's pattern, and what stands between two spaces is encoded once.  An Aho-Corasick automaton
gives the longest tokens; a table of token pairs says which tokens may stand side by side; where the
longest do not fit, the encoder backtracks to shorter ones.  A sequence whose neighbours are
all compatible is the one that the merges give, so the result is exact, in time linear in the
text.  Decoding cuts the tokens' bytes out of one buffer by a table of offsets.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.units import Memo, Ragged, UnitTable, cut_units

#: Where the public vocabularies are.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

class BytePairEncoder:
    """Exact byte-level BPE from a rank file (a token in base64 and its rank on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.pieces = Memo(lambda p: np.array(self.encode_bytes(p.encode("utf-8")), dtype=np.int32).tobytes())
        self.first, self.rest = UnitTable(self._unit, ""), UnitTable(self._unit, " ")

    def merge(self, data: bytes) -> list[int]:
        """The merges by their ranks, lowest first: the definition, used for pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side: their bytes merge to just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text = data.decode("latin-1")
        greedy = [rank for _, rank in self.automaton.iter_long(text)]
        if sum(len(self.tokens[t]) for t in greedy) == len(data) and all(map(self.fits, greedy, greedy[1:])):
            return greedy
        return self._backtrack(data, text)

    def _backtrack(self, data: bytes, text: str) -> list[int]:
        longest = [0] * len(data)
        for end, rank in self.automaton.iter(text):
            size = len(self.tokens[rank])
            longest[end + 1 - size] = max(longest[end + 1 - size], size)
        dead = bytearray(len(data) + 1)
        out: list[int] = []
        at, size = 0, longest[0]
        while at < len(data):
            while size:
                token = self.ranks.get(data[at : at + size])
                if token is not None and not dead[at + size] and (not out or self.fits(out[-1], token)):
                    break
                size -= 1
            if size:
                out.append(token)
                at += size
                size = longest[at] if at < len(data) else 0
            else:  # nothing fits here: take the last token back and try a shorter one
                dead[at] = 1
                if not out:
                    raise ValueError("these bytes cannot be encoded")
                last = len(self.tokens[out.pop()])
                at -= last
                size = last - 1
        return out

    def _unit(self, unit: str, lead: str) -> bytes:
        return self._pack(lead + unit)

    def _pack(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a text as packed 32-bit integers; nothing for null and empty texts."""
        if not text:
            return b""
        first, rest = cut_units(text)
        try:
            return self.first[first] + b"".join(map(self.rest.__getitem__, rest))
        except Ragged:
            return self._pack(text)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty list for null and empty texts."""
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes in one buffer, and where each begins (one more entry than tokens)."""
        offsets = np.zeros(len(self.tokens) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in self.tokens], out=offsets[1:])
        return np.frombuffer(b"".join(self.tokens), np.uint8), offsets


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> BytePairEncoder:
    """The encoder of a rank file, built once for each worker process."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def decode_lists(values: np.ndarray, offsets: np.ndarray, buffer: np.ndarray, starts: np.ndarray) -> list[str]:
    """The texts of lists of ids, given as flat ids and the offsets of the lists."""
    sizes = starts[values + 1] - starts[values]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(starts[values], sizes)
    data = buffer[index].tobytes()
    return [data[ends[a] : ends[b]].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]


#: Bytes of ids that one batch of results may hold.
BATCH_BYTES = 64_000_000


def _lists(keys: pa.Array, rows: list[bytes], key: str) -> pa.RecordBatch:
    """Keys and packed ids as a batch of lists."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    flat = pa.array(np.frombuffer(b"".join(rows), np.int32))
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=[key, "ids"])


def encode_corpus(documents: DataFrame, *, text: str = "text", key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ids (array of int) of every document, without special tokens.

    Null and empty texts give an empty array; strings of special tokens are ordinary text.  Each row is
    encoded for itself, so repeated rows and keys give repeated rows; an empty table gives none; a null
    key stays null.  Texts are encoded whole, of any length; other columns are dropped.

    Scale: one scan without a shuffle.  A worker holds the vocabulary and a bounded table of pieces.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(name, folder).encode_packed
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[bytes] = []
            size = first = 0
            for i in range(len(batch)):
                row = packed(texts[i].as_py())
                rows.append(row)
                size += len(row)
                if size > BATCH_BYTES:  # long texts: hand on what there is
                    yield _lists(keys.slice(first, len(rows)), rows, key)
                    rows, size, first = [], 0, i + 1
            yield _lists(keys.slice(first, len(rows)), rows, key)

    return documents.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, *, ids: str = "ids", key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and text of lists of ids: the inverse of encode_corpus, null lists giving empty texts.

    Ids outside of the vocabulary are an error.  Bytes that are no UTF-8 become replacement characters.
    """
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, starts = encoder(name, folder).decoder()
        for batch in batches:
            lists = batch.column(1).fill_null([])
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
            texts = decode_lists(values, offsets - offsets[0], buffer, starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, F.col(ids).alias("__ids")).mapInArrow(run, f"`{key}` {kind}, text string")
