"""Encoding a corpus with a public byte-level BPE, on contiguous rank arrays.

A text is split into short words by the tokenizer's pattern. All words of one
byte length are encoded together: a matrix holds, per word, the ids between its
part boundaries and the rank of every adjacent pair in contiguous rows. Each
sweep scans the ranks for the minimum, merges there (deleting one boundary) and
refreshes the two neighbouring ranks, until no pair of any word has a rank.
Words are encoded once per worker; a text's ids are gathered from the pool.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.io import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(2**31 - 1)  # rank of a pair that never merges
_ROW_WORD = 64  # words up to so many bytes go through the matrix, longer ones through a heap
_POOL_WORDS = 400_000  # words a worker remembers before it starts anew
_CHUNK_CHARS = 1_000_000  # texts are cut into words so many characters at a time


class RankArrays:
    """Encoder for one vocabulary: lines of base64 token and rank, ranks being the ids."""

    def __init__(self, lines: bytes):
        import regex

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines.splitlines() if line.strip())}
        self.ranks = ranks
        self.split = regex.compile(PATTERN)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.base = max(ranks.values()) + 1
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    ids.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ids = np.array(keys, np.int64)[order], np.array(ids, np.int32)[order]
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ids[at], _NONE)

    def encode_equal(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of m words of n bytes, given as an m x n byte matrix; ids beyond a count are -1."""
        m, n = words.shape
        ids = self.byte_ids[words]
        counts = np.full(m, n)
        if n < 2:
            return ids, counts
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(m)
        part, prank = ids, rank  # rows still merging
        columns = np.arange(n)
        while len(live):
            at = prank.argmin(1)
            row = np.arange(len(live))
            best = prank[row, at]
            go = best < _NONE
            if not go.all():
                ids[live[~go]] = part[~go]
                live, part, prank, at, best = live[go], part[go], prank[go], at[go], best[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            # delete the boundary after `at`: what lies right of it moves one place left
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), n - 1)
            part = np.take_along_axis(part, source, 1)
            part[:, -1] = -1
            part[row, at] = best
            prank = np.take_along_axis(prank, np.minimum(source[:, :-1], n - 2), 1)
            prank[:, -1] = _NONE
            right = np.where(at + 1 < n, part[row, np.minimum(at + 1, n - 1)], -1)
            prank[row, np.minimum(at, n - 2)] = np.where(at < n - 1, self.pair_rank(best, right), prank[row, np.minimum(at, n - 2)])
            left = at > 0
            prank[row[left], at[left] - 1] = self.pair_rank(part[row[left], at[left] - 1], best[left])
            counts[live] -= 1
        return ids, counts

    def encode_long(self, word: bytes) -> list[int]:
        """One word of any length: the same merges off a heap, linear memory and n log n time."""
        ids: list = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)
        pairs = self._pairs()
        base = self.base
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                q = pairs.get(r * base + ids[k])
                if q is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            h = prv[i]
            if h >= 0:
                q = pairs.get(ids[h] * base + r)
                if q is not None:
                    heapq.heappush(heap, (q, h, ids[h], r))
        return [x for x in ids if x is not None]

    @lru_cache(1)
    def _pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ids.tolist()))

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new words to the pool."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        known, by_length, longer = [], {}, []
        for k, b in enumerate(coded):
            r = self.ranks.get(b)
            if r is not None:
                known.append((k, r))
            elif len(b) <= _ROW_WORD:
                by_length.setdefault(len(b), []).append(k)
            else:
                longer.append(k)
        order, parts, counts = [], [], []
        if known:
            order.extend(k for k, _ in known)
            parts.append(np.array([r for _, r in known], np.int32))
            counts.append(np.ones(len(known), np.int64))
        for n, rows in by_length.items():
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                ids, c = self.encode_equal(np.frombuffer(b"".join(coded[k] for k in some), np.uint8).reshape(len(some), n))
                order.extend(some)
                parts.append(ids[np.arange(n)[None, :] < c[:, None]])
                counts.append(c.astype(np.int64))
        for k in longer:
            ids = np.array(self.encode_long(coded[k]), np.int32)
            order.append(k)
            parts.append(ids)
            counts.append(np.array([len(ids)], np.int64))
        lengths = np.concatenate(counts)
        starts = len(self.pool) + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        base = len(self.lengths)
        self.slot.update((words[k], base + i) for i, k in enumerate(order))
        self.pool = np.concatenate([self.pool, *parts])
        self.lengths, self.starts = np.concatenate([self.lengths, lengths]), np.concatenate([self.starts, starts])

    def _chunks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= _CHUNK_CHARS:
            yield self.split.findall(text)
            return
        found = self.split.finditer(text)
        while some := [m.group() for m in islice(found, 200_000)]:
            yield some

    def _slots(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.slot)
        if new:
            if len(self.slot) + len(new) > _POOL_WORDS and self.slot:
                self._forget()
                new = set(words)
            self._learn(list(new))
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def groups(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
        """(first text, end, words) of runs of texts, or of parts of one very long text."""
        at, words, ends, chars = 0, [], [], 0
        for k, t in enumerate(texts):
            t = t or ""
            if len(t) > _CHUNK_CHARS:
                if k > at:
                    yield at, ends, words
                for some in self._chunks(t):
                    yield k, None, some
                at, words, ends, chars = k + 1, [], [], 0
                continue
            words += self.split.findall(t)
            ends.append(len(words))
            chars += len(t)
            if chars > _CHUNK_CHARS:
                yield at, ends, words
                at, words, ends, chars = k + 1, [], [], 0
        if ends:
            yield at, ends, words

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of every text."""
        out = np.zeros(len(texts), np.int64)
        for at, ends, words in self.groups(texts):
            slots = self._slots(words)
            total = np.concatenate([[0], np.cumsum(self.lengths[slots])])
            if ends is None:
                out[at] += total[-1]
            else:
                e = np.array(ends)
                out[at : at + len(e)] = total[e] - total[np.concatenate([[0], e[:-1]])]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of every text)."""
        counts, parts = np.zeros(len(texts), np.int64), []
        for at, ends, words in self.groups(texts):
            slots = self._slots(words)
            lengths = self.lengths[slots]
            total = np.concatenate([[0], np.cumsum(lengths)])
            where = np.repeat(self.starts[slots] - total[:-1], lengths) + np.arange(total[-1])
            parts.append(self.pool[where])
            if ends is None:
                counts[at] += total[-1]
            else:
                e = np.array(ends)
                counts[at : at + len(e)] = total[e] - total[np.concatenate([[0], e[:-1]])]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), counts


_ENCODERS: dict[str, RankArrays] = {}


def encoder(lines: bytes) -> RankArrays:
    """The encoder of a vocabulary, built once per worker process."""
    key = hashlib.sha1(lines).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = RankArrays(lines)
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast variable; under 1 MB, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of every text, without special tokens.

    Strings of special tokens are ordinary text. An empty and a null text have
    no ids: an empty array. Texts of any length; repeated rows are all kept;
    extra columns don't matter.
    """
    lines = vocabulary(documents.sparkSession, path)

    def run(batches):
        code = encoder(lines.value)
        for batch in batches:
            ids, counts = code.encode(batch.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "ids"])

    return documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens): the number of ids of every text, 0 of empty and null ones."""
    lines = vocabulary(documents.sparkSession, path)

    def run(batches):
        code = encoder(lines.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.counts(batch.column(1).to_pylist()))], names=["doc_id", "tokens"])

    return documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id bigint, tokens bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
