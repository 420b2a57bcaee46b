"""Byte-level BPE of a whole corpus with a public tokenizer (problem 8).

Distinct pre-tokens of a batch are put into padded numpy matrices, one per bucket of lengths.
In every round each row merges its leftmost pair of least rank, found by a hashed pair
lookup; the hole is closed by compaction and finished rows leave the matrix. Texts are then
gathered from the pool of encoded pre-tokens by offsets.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.session import spread

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that cuts text for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_INF = np.int32(2**30)


class PairTable:
    """Open-addressed table from (left id, right id) to the id of their merge, which is also its rank."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(10, (3 * max(1, len(pairs))).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _INF, np.int32)
        key = np.array([a << 20 | b for a, b in pairs], np.int64)
        val = np.array(list(pairs.values()), np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(key), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = key[put], val[put]
            key, val, slot = key[~put], val[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a large number where it does not merge or an id is negative."""
        out = np.full(left.shape, _INF, np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        key = left.ravel()[live].astype(np.int64) << 20 | right.ravel()[live].astype(np.int64)
        slot = self._slot(key)
        flat = out.ravel()
        while len(live):
            here = self.keys[slot]
            hit = here == key
            flat[live[hit]] = self.values[slot[hit]]
            go = ~hit & (here >= 0)
            live, key, slot = live[go], key[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(left.shape)


class Encoder:
    """A vocabulary of byte ranks with a pool of the pre-tokens met so far."""

    MOST = 300_000
    #: Bytes of a pre-token from which all places of its least pair are merged in one round.
    LONG = 1024

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.split = regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.table = PairTable(pairs)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        length = np.array([len(w) for w in words], np.int64)
        order = np.argsort(length, kind="stable")
        lo = 0
        while lo < len(order):
            n = max(1, int(length[order[lo]]))
            if n > self.LONG:
                out[order[lo]] = self._long(self.bytes[np.frombuffer(words[order[lo]], np.uint8)])
                lo += 1
                continue
            hi = min(int(np.searchsorted(length[order], n + n // 4, side="right")), lo + max(1, 2_000_000 // n))
            rows = order[lo:hi]
            lo = hi
            wide = int(length[rows[-1]])
            ids = np.full((len(rows), max(wide, 1)), -1, np.int32)
            flat = self.bytes[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
            ids[np.arange(ids.shape[1]) < length[rows][:, None]] = flat
            self._rounds(ids, rows, length[rows].copy(), out)
        return out

    def _rounds(self, ids: np.ndarray, rows: np.ndarray, length: np.ndarray, out: list[np.ndarray]) -> None:
        rank = self.table.find(ids[:, :-1], ids[:, 1:])
        while True:
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                least = rank[np.arange(len(rows)), at]
            else:
                at, least = np.zeros(len(rows), np.int64), np.full(len(rows), _INF)
            done = least >= _INF
            if done.any():
                for r in np.flatnonzero(done):
                    out[rows[r]] = ids[r, : length[r]].copy()
                stay = ~done
                if not stay.any():
                    return
                wide = int(length[stay].max())
                ids, rank, rows, length, at, least = ids[stay, :wide], rank[stay, : wide - 1], rows[stay], length[stay], at[stay], least[stay]
            n = np.arange(len(rows))
            ids[n, at] = least
            move = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > at[:, None])
            ids = np.take_along_axis(ids, np.where(move >= ids.shape[1], 0, move), axis=1)
            length -= 1
            ids[np.arange(ids.shape[1]) >= length[:, None]] = -1
            if ids.shape[1] < 2:
                rank = np.full((len(rows), 0), _INF, np.int32)
                continue
            move = np.arange(rank.shape[1] - 1) + (np.arange(rank.shape[1] - 1) >= at[:, None])
            rank = np.take_along_axis(rank, move, axis=1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < rank.shape[1])
                r, c = n[ok], side[ok]
                rank[r, c] = self.table.find(ids[r, c], ids[r, c + 1])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """Token ids of one long pre-token.

        A round merges the least pair everywhere, from the left where places overlap. That is what
        one merge after the other gives unless a new pair has a lower rank; then only the leftmost is merged.
        """
        rank = self.table.find(ids[None, :-1], ids[None, 1:])[0]
        while len(rank) and (least := rank.min()) < _INF:
            at = np.flatnonzero(rank == least)
            head = np.append(True, np.diff(at) != 1)
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))) % 2 == 0]
            while True:
                new, left = ids.copy(), np.ones(len(ids), bool)
                new[at] = least
                left[at + 1] = False
                new, keep = new[left], np.ones(len(rank), bool)
                keep[at] = False
                fresh, place = rank[keep], at - np.arange(len(at))
                side = np.unique(np.concatenate([place - 1, place]))
                side = side[(side >= 0) & (side < len(fresh))]
                fresh[side] = self.table.find(new[None, side], new[None, side + 1])[0]
                if len(at) == 1 or not len(side) or fresh[side].min() > least:
                    break
                at = at[:1]
            ids, rank = new, fresh
        return ids

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index into the pool for every pre-token of all texts, pre-tokens per text)."""
        if len(self.index) > self.MOST:
            self._forget()
        cut = [self.split.findall(t) for t in texts]
        index = self.index
        new: dict[str, int] = {}
        known = len(index)
        for words in cut:
            for w in words:
                if w not in index and w not in new:
                    new[w] = known + len(new)
        if new:
            made = self.merge([w.encode("utf-8") for w in new])
            size = np.array([len(x) for x in made], np.int64)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, *made])
            index.update(new)
        count = np.array([len(x) for x in cut], np.int64)
        at = np.fromiter((index[w] for words in cut for w in words), np.int64, int(count.sum()))
        return at, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in sequence, offsets of the texts)."""
        at, count = self.places(texts)
        size = self.size[at]
        end = np.cumsum(size)
        place = np.repeat(self.start[at] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        offsets = np.zeros(len(texts) + 1, np.int64)
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
        offsets[:] = bounds
        return self.pool[place], offsets

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        at, count = self.places(texts)
        whole = np.concatenate([[0], np.cumsum(self.size[at])])
        edge = np.concatenate([[0], np.cumsum(count)])
        return whole[edge[1:]] - whole[edge[:-1]]


@functools.lru_cache(maxsize=1)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a rank file, built once in each worker."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks)


def _groups(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids) for every row; null and empty texts have the empty list. Special tokens are ordinary text; repeated rows stay."""
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _groups(texts):
                ids, offsets = enc.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], names=["id", "ids"])

    return spread(rows).mapInArrow(run, StructType([StructField("id", rows.schema["id"].dataType), StructField("ids", ArrayType(IntegerType()))]))


def token_counts(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens) for every row, by the same encoder without keeping the ids."""
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.concatenate([np.zeros(0, np.int64), *(enc.count(texts[lo:hi]) for lo, hi in _groups(texts))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32))], names=["id", "n_tokens"])

    return spread(rows).mapInArrow(run, StructType([StructField("id", rows.schema["id"].dataType), StructField("n_tokens", IntegerType())]))
