"""Encoding against the public library, by definition and by round trip."""

import os
import random

import pytest

bpe = pytest.importorskip("lodestat.llm.bpe")
if not os.path.isdir(bpe.TOKENIZERS):
    pytest.skip("the public vocabularies are not here", allow_module_level=True)

ODD = ["", " ", "  ", "\n", "a", "it's IT'S", "<|endoftext|>", " <|endoftext|> x", "日本語のテキスト。", "ไทยไม่มีช่องว่าง", "naïvé 🙂👩‍🔬", "a b  c", "x" * 3000, "  lead", "trail  ", "a  b   c", "tab\t\ttab \n\n x", "​", "12345678901 3.14", " \n a \n"]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def texts():
    rng = random.Random(3)
    bits = ["a", "b", " the", "ing", "é", "中", "ไ", "\n", "1", "!", "<|endoftext|>", "​", "ß", "🙂", "aaaa", " ", "  ", "ა", "ह"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(600)]


def test_against_the_library():
    encode, e = library(), bpe.encoder()
    for t in texts():
        assert e.encode(t) == encode(t), ascii(t[:80])


def test_against_the_merges():
    e = bpe.encoder()
    for t in texts()[:200]:
        for piece in e.split(t[:400]):
            data = piece.encode()
            if len(data) < 200:
                assert e.encode_bytes(data) == e.merge(data)


def test_backtracking_gives_the_merges_too():
    e = bpe.encoder()
    for word in ("unbelievably", "antidisestablishmentarianism", "mississippi", "xyzzyx", "ไทยไทย"):
        data = word.encode()
        assert e._backtrack(data, data.decode("latin-1")) == e.merge(data)


def test_every_token_is_reachable():
    e = bpe.encoder()
    assert all(e.encode_bytes(t) == [i] for i, t in enumerate(e.tokens) if t)


def test_tables_start_anew_without_changing_results(monkeypatch):
    from lodestat.llm import units

    monkeypatch.setattr(units, "CACHE_UNITS", 5)
    fresh = bpe.BytePairEncoder(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    encode = library()
    assert all(fresh.encode(t) == encode(t) for t in texts()[:120])


def test_batches_of_long_texts_are_split():
    import numpy as np
    import pyarrow as pa

    batch = bpe._lists(pa.array([1, 2, 3]), [np.array([5, 6], np.int32).tobytes(), b"", np.array([7], np.int32).tobytes()], "k")
    assert batch.to_pydict() == {"k": [1, 2, 3], "ids": [[5, 6], [], [7]]}


def test_round_trip(spark):
    rows = [(i, t, "x", [1]) for i, t in enumerate(ODD)] + [(100, None, None, None), (None, "a", None, None), (0, "again", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, ids array<int>")
    enc = bpe.encode_corpus(df)
    got = {(r.doc_id, tuple(r.ids)) for r in enc.collect()}
    assert (100, ()) in got and (0, ()) in got and enc.count() == len(rows)
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in bpe.decode_corpus(enc).collect())
    assert back == sorted((i if i is not None else -1, t or "") for i, t, *_ in rows)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
