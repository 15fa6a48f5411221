"""Filling containers of a fixed capacity with texts, sized in tokens.

Texts are sized once for each tokenizer.  Within a shard, containers are filled by best-two-fit: fill
greedily with the largest that fits, then replace the container's smallest text by two unpacked ones
that fit the widened gap more tightly.  Sizes still to be packed are bits of one integer, so that both
steps are a few shifts and no search.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.bpe import TOKENIZERS, encoder
from lodestat.llm.units import Memo, Ragged, UnitTable, cut_units

#: Texts packed together; every shard leaves at most about one container badly filled.
ITEMS_PER_SHARD = 50_000
#: Rows that a table of targets may have; it is read to the driver.
MAX_TARGETS = 1_000

_UPPER_CONTRACTION = regex.compile(r"'\p{Lu}")
#: Bits of one tokenizer's count in a unit's value.
_SHIFT = 40


class TokenCounter:
    """Counts the tokens of texts for some of the public tokenizers; the splits are shared."""

    def __init__(self, names: list[str], folder: str = TOKENIZERS):
        self.names = names
        self.bpe: list[tuple[int, object]] = []
        self.words: list[tuple[int, object, Memo]] = []
        self.models: list[tuple[int, object]] = []
        self.split = encoder(folder=folder).split
        for i, name in enumerate(names):
            if os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
                self.bpe.append((i * _SHIFT, encoder(name, folder)))
            elif os.path.exists(os.path.join(folder, f"{name}.json")):
                from tokenizers import Tokenizer

                words = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
                words.encode_special_tokens = True
                count = lambda t, w=words: len(w.encode(t, add_special_tokens=False).ids)
                self.words.append((i * _SHIFT, count, Memo(count)))
            else:
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
                self.models.append((i * _SHIFT, model))
        self.first, self.rest = UnitTable(self._unit, ""), UnitTable(self._unit, " ")

    def _unit(self, unit: str, lead: str) -> int:
        """The counts of a unit by all tokenizers, in one integer."""
        text = lead + unit
        pieces = self.split(text)
        value = sum(sum(map(len, map(b.pieces.__getitem__, pieces))) // 4 << at for at, b in self.bpe)
        for at, whole, memo in self.words:
            composed = text if text.isascii() else unicodedata.normalize("NFC", text)
            if _UPPER_CONTRACTION.search(composed) or "İ" in composed:
                value += whole(text) << at  # lower case splits these differently
            else:
                value += sum(map(memo.__getitem__, pieces if composed == text else self.split(composed))) << at
        for at, model in self.models:
            # the model puts a space before, but not before nothing
            value += (len(model.encode(unit, num_threads=1)) if unit else len(lead)) << at
        return value

    def count(self, text: str | None) -> list[int]:
        """The number of tokens by each tokenizer, in the order of names; 0 for null and empty texts."""
        if not text:
            return [0] * len(self.names)
        first, rest = cut_units(text)
        try:
            value = self.first[first] + sum(map(self.rest.__getitem__, rest))
        except Ragged:
            value = self._unit(text, "")
        return [(value >> (i * _SHIFT)) & ((1 << _SHIFT) - 1) for i in range(len(self.names))]


_COUNTERS: dict[tuple, TokenCounter] = {}


def corpus_sizes(documents: DataFrame, names: list[str], *, text: str = "text", key: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """``key``, tokenizer, n_tokens of every document for each tokenizer.

    Null and empty texts have 0 tokens.  Repeated rows stay; an empty table gives none; a null key stays
    null.  Texts are sized whole.  One scan without a shuffle.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (folder, *names)
        if at not in _COUNTERS:
            _COUNTERS[at] = TokenCounter(names, folder)
        count = _COUNTERS[at].count
        for batch in batches:
            sizes = np.array([count(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(len(batch), len(names))
            index = pa.array(np.repeat(np.arange(len(batch)), len(names)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), pa.array(names * len(batch), pa.string()), pa.array(sizes.ravel())], names=[key, "tokenizer", "n_tokens"]
            )

    return documents.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, tokenizer string, n_tokens bigint")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each item of ``sizes``, none being above ``capacity``.

    Items of size 0 go into the first container.  Items of equal size are interchangeable and taken in order.
    """
    out = np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    held: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        held.setdefault(int(sizes[i]), []).append(i)
    held.pop(0, None)
    top = max(held, default=0)
    if top > capacity:
        raise ValueError("an item exceeds the capacity")
    free = mirror = 0  # sizes still to be packed, as bits from below and from above
    for s in held:
        free |= 1 << s
        mirror |= 1 << (top - s)

    def take(s: int) -> int:
        nonlocal free, mirror
        items = held[s]
        i = items.pop()
        if not items:
            free ^= 1 << s
            mirror ^= 1 << (top - s)
        return i

    def give(s: int, i: int) -> None:
        nonlocal free, mirror
        items = held[s]
        if not items:
            free |= 1 << s
            mirror |= 1 << (top - s)
        items.append(i)

    container = 0
    while free:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while True:
            fitting = free & ((2 << gap) - 1)
            if not fitting:
                break
            s = fitting.bit_length() - 1
            inside.append((s, take(s)))
            gap -= s
        while gap and free:
            smallest, at = inside[-1]  # greedy filling takes sizes in falling order
            pair = _two(free, mirror, top, smallest, smallest + gap, held)
            if pair is None:
                break
            inside.pop()
            inside += [(s, take(s)) for s in pair]
            give(smallest, at)
            gap += smallest - sum(pair)
            inside.sort(key=lambda x: -x[0])
        for _, i in inside:
            out[i] = container
        container += 1
    return out


def _two(free: int, mirror: int, top: int, least: int, most: int, held: dict[int, list[int]]) -> tuple[int, int] | None:
    """Two unpacked sizes of the largest sum in (least, most]."""
    for total in range(min(most, 2 * top), least, -1):
        shift = top - total
        firsts = free & ((mirror >> shift) if shift >= 0 else (mirror << -shift))
        while firsts:
            a = firsts.bit_length() - 1
            b = total - a
            if a != b or len(held[a]) > 1:
                return (a, b)
            firsts ^= 1 << a
    return None


def pack_corpus(
    documents: DataFrame, targets: DataFrame, *, text: str = "text", key: str = "doc_id", folder: str = TOKENIZERS, items_per_shard: int = ITEMS_PER_SHARD
) -> DataFrame:
    """The container of every text or piece for each target: target_id, container_id, ``key``, piece_no, start_token, n_tokens.

    ``targets`` has target_id, tokenizer, capacity_tokens.  A text is split only if it alone exceeds the capacity: into
    full containers and a rest.  Texts of 0 tokens go into a container without needing room; null texts are no
    texts and are left out.  Repeated rows are items of their own.  An empty table of either kind gives no rows.
    Targets with nulls or a capacity below 1 are left out.

    Scale: one scan sizes the texts; (target, shard) groups of about ``items_per_shard`` narrow rows, one for each text,
    are packed.  Pieces that fill a container are only written out afterwards.  Shards are spread by row number, so
    no key is hot.
    """
    rows = targets.select("target_id", "tokenizer", "capacity_tokens").where("target_id IS NOT NULL AND tokenizer IS NOT NULL AND capacity_tokens > 0").distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    kind = documents.schema[key].dataType.simpleString()
    schema = f"target_id string, container_id string, `{key}` {kind}, piece_no bigint, start_token bigint, n_tokens bigint"
    if not rows:
        return documents.sparkSession.createDataFrame([], schema)
    texts = documents.where(F.col(text).isNotNull())
    shards = max(1, -(-documents.count() // items_per_shard))
    sized = corpus_sizes(texts, sorted({r.tokenizer for r in rows}), text=text, key=key, folder=folder)
    sized = sized.withColumn("__row", F.monotonically_increasing_id())
    choices = F.array(*[F.struct(F.lit(r.target_id).alias("target_id"), F.lit(r.tokenizer).alias("of"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity")) for r in sorted(rows)])
    items = sized.withColumn("__t", F.explode(F.filter(choices, lambda c: c["of"] == F.col("tokenizer"))))
    cap = F.col("__t.capacity")
    full = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / cap) - 1)  # pieces that fill a container each
    items = items.select(
        F.col("__t.target_id").alias("target_id"), cap.alias("capacity"), key, full.alias("__full"),
        (F.col("n_tokens") - full * cap).alias("__rest"), "__row", F.pmod(F.xxhash64("__row"), F.lit(shards)).cast("int").alias("__shard"),
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__row", kind="stable")
        at = best_two_fit(group["__rest"].to_numpy(np.int64), int(group["capacity"].iloc[0]))
        prefix = f"{group['target_id'].iloc[0]}-{group['__shard'].iloc[0]}-"
        return group.assign(container_id=[prefix + str(c) for c in at.tolist()])[[*columns, "container_id"]]

    columns = ["target_id", "capacity", key, "__full", "__rest", "__row"]
    packed = items.groupBy("target_id", "__shard").applyInPandas(
        pack, f"target_id string, capacity bigint, `{key}` {kind}, __full bigint, __rest bigint, __row bigint, container_id string"
    )
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__full"))).alias("piece_no")
    last = F.col("piece_no") == F.col("__full")
    return packed.select("*", piece).select(
        "target_id",
        F.when(last, F.col("container_id")).otherwise(F.concat_ws("-", "target_id", F.lit("full"), "__row", "piece_no")).alias("container_id"),
        key, "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.when(last, F.col("__rest")).otherwise(F.col("capacity")).alias("n_tokens"),
    )


def fill_report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, n_containers, n_tokens, fewest: the containers used, and as many as there must be at least."""
    per = packed.groupBy("target_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.join(targets.select("target_id", "capacity_tokens"), "target_id").select(
        "target_id", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("fewest")
    )
