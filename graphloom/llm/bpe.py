"""Byte-level BPE encoding of a corpus in numpy.

Texts are split by the tokenizer's pattern; the distinct pieces of a batch become rows of padded matrices, bucketed by
length. In each round every row merges its leftmost pair of minimum rank: ranks come from an open-addressing hash table
over pairs, only the pairs at the merge are looked up again, each row loses one column (compaction), and rows without a
pair left leave the matrix.

Defined results: null and empty texts give an empty list; spellings of special tokens are plain text; every text is
encoded whole, however long; repeated rows each give a row; extra columns are never read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.runtime import spread

#: Vocabulary as ranks: lines of base64 token and rank. A parameter; the file stays where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that public vocabulary splits texts (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int32(2**31 - 1)
#: Cells of one matrix at most.
_CELLS = 2_000_000
#: Pieces of more bytes are merged on their own, many pairs a round.
_LONG = 512
#: Distinct pieces kept with their ids between batches of a task.
_KEPT = 200_000


class BytePairEncoder:
    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> None:
        with open(vocabulary, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern)
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(r)
        self._table(np.array(keys, np.int64), np.array(values, np.int32))
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.slots, self.ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        at, left = self._slot(keys, self.bits), np.arange(len(keys))
        while len(left):  # one probe step for all keys left; the first of those that meet in a free slot stays
            free = self.slots[at[left]] == -1
            placed, first = np.unique(at[left][free], return_index=True)
            winners = left[free][first]
            self.slots[placed], self.ranks[placed] = keys[winners], values[winners]
            left = np.setdiff1d(left, winners)
            at[left] = (at[left] + 1) & (size - 1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it does not merge."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(keys.shape, _NONE, np.int32)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        flat, k = out.reshape(-1), keys.reshape(-1)[ok]
        at = self._slot(k, self.bits)
        while len(ok):
            seen = self.slots[at]
            hit = seen == k
            flat[ok[hit]] = self.ranks[at[hit]]
            go = ~hit & (seen != -1)
            ok, k, at = ok[go], k[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge_rows(self, m: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """Ids of each row; m is padded with -1."""
        done: list[np.ndarray] = [np.empty(0, np.int32)] * len(m)
        row, ranks = np.arange(len(m)), self.pair_ranks(m[:, :-1], m[:, 1:])
        while len(row):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)  # the first of equal ranks: the leftmost
                low = ranks[np.arange(len(row)), at]
            else:
                at, low = np.zeros(len(row), np.int64), np.full(len(row), _NONE, np.int32)
            over = low == _NONE
            if over.any():
                for i in np.flatnonzero(over):
                    done[row[i]] = m[i, : length[i]].copy()
                go = ~over
                row, m, ranks, length, at, low = row[go], m[go], ranks[go], length[go], at[go], low[go]
                if not len(row):
                    break
            n, w = m.shape
            r = np.arange(n)
            m[r, at] = low  # an id is its rank
            keep = np.ones((n, w), bool)
            keep[r, at + 1] = False
            m = m[keep].reshape(n, w - 1)
            ranks = ranks[keep[:, 1:]].reshape(n, w - 2)
            length = length - 1
            left = at > 0
            if left.any():
                lr, la = r[left], at[left] - 1
                ranks[lr, la] = self.pair_ranks(m[lr, la], m[lr, la + 1])
            right = at < w - 2
            if right.any():
                rr, ra = r[right], at[right]
                ranks[rr, ra] = self.pair_ranks(m[rr, ra], m[rr, ra + 1])
            widest = int(length.max())
            if widest < m.shape[1] // 2:
                m, ranks = m[:, :widest].copy(), ranks[:, : max(0, widest - 1)].copy()
        return done

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Ids of one long piece: a round merges all pairs of the minimum rank, left to right.

        That is what single merges from the left come to unless a new pair has a lower rank; then one merge is made.
        """
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == low)
            first = np.concatenate([[True], np.diff(at) != 1])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]  # of pairs that overlap every other one, from the left
            for take in (at, at[:1]):
                new = ids.copy()
                new[take] = low
                keep = np.ones(len(ids), bool)
                keep[take + 1] = False
                new = new[keep]
                after = self.pair_ranks(new[:-1], new[1:])
                if len(take) == 1 or not len(after) or after.min() > low:
                    break
            ids, ranks = new, after
        return ids

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        raw = [p.encode("utf-8") for p in pieces]
        size = np.array([len(b) for b in raw])
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(raw)
        order = np.argsort(size, kind="stable")
        bounds = [0, *(2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 48, 64)]
        while bounds[-1] < (int(size[order[-1]]) if len(raw) else 0):
            bounds.append(bounds[-1] * 2)
        for low, high in zip(bounds, bounds[1:]):
            bucket = order[np.searchsorted(size[order], low, "right") : np.searchsorted(size[order], high, "right")]
            if low >= _LONG:
                for i in bucket:
                    out[i] = self._merge_long(self.byte_id[np.frombuffer(raw[i], np.uint8)].astype(np.int32))
                continue
            step = max(1, _CELLS // high)
            for k in range(0, len(bucket), step):
                part = bucket[k : k + step]
                lens = size[part]
                width = int(lens.max())
                m = np.full((len(part), width), -1, np.int32)
                m[np.arange(width) < lens[:, None]] = self.byte_id[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                for i, ids in zip(part, self._merge_rows(m, lens), strict=True):
                    out[i] = ids
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and all ids in a row."""
        number: dict[str, int] = {}
        flat: list[int] = []
        counts = [0]
        for t in texts:
            flat += [number.setdefault(p, len(number)) for p in (self.split.findall(t) if t else ())]
            counts.append(len(flat))
        pieces = list(number)
        new = [p for p in pieces if p not in self.known]
        fresh = dict(zip(new, self.encode_pieces(new), strict=True))
        ids = [self.known[p] if p in self.known else fresh[p] for p in pieces]
        if len(self.known) + len(fresh) > _KEPT:
            self.known = {}
        if len(fresh) <= _KEPT:
            self.known |= {p: a for p, a in fresh.items() if len(p) <= 64}
        lens = np.array([len(a) for a in ids], np.int64)
        joined = np.concatenate(ids) if ids else np.empty(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(lens)])[:-1] if len(ids) else np.empty(0, np.int64)
        at = np.array(flat, np.int64)
        n = lens[at] if len(at) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        pos = np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(starts[at] if len(at) else starts, n)
        return ends[np.array(counts)], joined[pos] if len(pos) else np.empty(0, np.int32)


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> BytePairEncoder:
    return BytePairEncoder(vocabulary)


def _slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that its texts hold about ``most`` bytes each; a longer text stays whole."""
    size = np.cumsum([0, *(len(t) if t else 0 for t in batch.column(column).to_pylist())])
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, size[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for b in _slices(whole, "text"):
                ends, ids = enc.encode_batch(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")
