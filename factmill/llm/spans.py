"""Long exact spans shared between records, by fixed-block anchors.

The texts are cut into non-overlapping reference blocks of 20 characters. Nine
adjacent blocks (180 characters) are one index entry, so that any span of 200
characters holds a whole entry, wherever it starts. The index is probed with the
rolling windows of 180 characters of all texts, and hits are extended on the
texts to maximal exact repeats: a pair counts only with one of 200 characters.

Blocks of 100 characters would be the longest that every span holds whole, but
by themselves they would pair all texts with the same notice of 128 characters.

Most windows of a corpus match nothing, and shipping them all would cost many
times the input. They are pruned without loss: of every 73 successive grams of
128 characters the least by hash is chosen, so two texts that share 200
characters choose the same gram in it. Only windows within 200 characters of a
gram that another text chose too are probed, and of these only the phases that
the reference blocks of the gram's other texts can have.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factmill.io import materialize, table

LEAST = 200  # characters a shared span has at least
BLOCK = 20  # reference blocks; an index entry is the most blocks that any span holds whole
GRAM = 128  # grams of the pruning: the longer, the less boilerplate is probed, and the more grams are chosen
HOT_SHARE = 1000
HOT_ENTRY = 2048  # rows of an entry that meet in one task; of more, each task takes a share
HASH_BYTES = 64 << 20  # of live grams in a partition, up to which they are joined by hash
_BATCH_CHARS = 2_000_000

# Rolling hash: a polynomial modulo 2^64 with an odd base, so windows come from prefix sums.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class _Tables:
    up = _powers(1, _BASE)
    down = _powers(1, _INVERSE)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Tables.up) < n:
        _Tables.up, _Tables.down = _powers(n + n // 4, _BASE), _powers(n + n // 4, _INVERSE)
    return _Tables.up, _Tables.down


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class Texts:
    """The code points of some texts in a row, with the hash of any window."""

    def __init__(self, texts: list[str]):
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(code)
        up, self._down = _tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((code + np.uint64(0x10001)) * up[:n], out=self.sums[1:])
        self.n = n

    def rolling(self, length: int) -> np.ndarray:
        """Hash of the window at every place; windows over the end of a text are among them."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        return _mix((self.sums[length:] - self.sums[:-length]) * self._down[: self.n - length + 1])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[places + length] - self.sums[places]) * self._down[places])

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


def _sliding(h: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every w successive values, from block-wise running values of both directions."""
    n = len(h)
    pad = -n % w
    blocks = np.concatenate([h, np.full(pad, h[-1], h.dtype)]).reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])


def chosen(texts: Texts, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are least among some ``least - gram + 1`` successive ones of a text."""
    w = least - gram + 1
    h = texts.rolling(gram)
    places = []
    # grams over the end of a text must not be chosen: texts are taken by themselves where they are long enough
    for s, e in zip(texts.starts.tolist(), texts.ends.tolist()):
        if e - s >= least:
            own = h[s : e - gram + 1]
            low = _sliding(own, w, np.minimum)
            # a gram is least in some window it lies in iff it equals the greatest of these windows' least
            full = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
            places.append(s + np.flatnonzero(_sliding(full, w, np.maximum) == own))
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return at, h[at]


def _runs(batch: pa.RecordBatch, text: int):
    """The rows of an Arrow batch in runs of bounded text size."""
    values = batch.column(text).to_pylist()
    at, chars = 0, 0
    for k, t in enumerate(values):
        chars += len(t)
        if chars >= _BATCH_CHARS or k + 1 == len(values):
            yield at, values[at : k + 1]
            at, chars = k + 1, 0


def _first(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of equal rows."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return np.sort(order[new])


def _documents(documents: DataFrame, id_column: str, text_column: str, least: int) -> DataFrame:
    rows = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.where(F.col("doc_id").isNotNull() & (F.char_length("text") >= least))


def _chosen_grams(docs: DataFrame, least: int, block: int, gram: int) -> DataFrame:
    """(gram, doc_id, phases): the chosen grams of every text with the set of their places modulo the block."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in _runs(batch, 1):
                t = Texts(texts)
                places, hashes = chosen(t, least, gram)
                who = t.owner(places)
                bits = np.int64(1) << ((places - t.starts[who]) % block)
                order = np.lexsort((hashes, who))
                who, hashes, bits = who[order], hashes[order], bits[order]
                new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (hashes[1:] != hashes[:-1])])) if len(who) else np.zeros(0, np.int64)
                phases = np.bitwise_or.reduceat(bits, new) if len(new) else bits
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[new].view(np.int64)), pa.array(ids[at + who[new]]), pa.array(phases)], names=["gram", "doc_id", "phases"]
                )

    return docs.mapInArrow(run, "gram bigint, doc_id bigint, phases bigint")


def _entries(docs: DataFrame, live: DataFrame, least: int, block: int, gram: int) -> DataFrame:
    """(entry, reference, doc_id): index entries and the rolling windows that may meet one, by the hash of their characters."""
    size = least - block
    reach = range(-(least - gram), block)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in _runs(batch, 1):
                t = Texts(texts)
                places, hashes = chosen(t, least, gram)
                some = pa.concat_arrays([batch.column(2).slice(at, len(texts))]).flatten()
                keys, phases = some.field(0).to_numpy().view(np.uint64), some.field(1).to_numpy()
                keys, first = np.unique(keys, return_index=True)
                phases = phases[first]  # a gram has the same phases in all texts
                hit = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                own = keys[hit] == hashes
                places, phases = places[own], phases[hit[own]]
                want = np.zeros(t.n + 1, bool)
                who = t.owner(places)
                low, high = t.starts[who], t.ends[who] - size
                for f in range(block):
                    of = (phases >> f) & 1 == 1
                    if of.any():
                        q, lo, hi = places[of], low[of], high[of]
                        for r in reach:
                            if (r + f) % block == 0:
                                s = q + r
                                want[s[(s >= lo) & (s <= hi)]] = True
                s = np.flatnonzero(want)
                who = t.owner(s)
                entry = t.at(s, size).view(np.int64)
                reference = (s - t.starts[who]) % block == 0
                keep = _first(who, entry, reference)
                yield pa.RecordBatch.from_arrays([pa.array(entry[keep]), pa.array(reference[keep]), pa.array(ids[at + who[keep]])], names=["entry", "reference", "doc_id"])

    # A hash join spares sorting the texts; grams too many for a partition's memory are sorted.
    grams = live.agg(F.sum(F.size("live") + 4)).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = docs.join(live.hint("shuffle_hash") if grams * 24 <= HASH_BYTES * parts else live, "doc_id").select("doc_id", "text", "live")
    return both.mapInArrow(run, "entry bigint, reference boolean, doc_id bigint")


def _hot_grams(grams: DataFrame) -> DataFrame:
    """(gram): all grams with more than 1 / HOT_SHARE of the rows, and at most 2 * HOT_SHARE grams.

    A partition tells its grams with half that share of its own rows. A hot gram
    keeps at least half its rows that way, as the partitions that don't tell it
    hold less than the other half; and so many rows can't have more grams.
    """

    share = 2 * HOT_SHARE

    def run(batches):
        parts = [batch.column(0).to_numpy() for batch in batches]
        if parts:
            own, n = np.unique(np.concatenate(parts), return_counts=True)
            often = n * share >= n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(own[often]), pa.array(n[often].astype(np.int64))], names=["gram", "n"])

    told = grams.select("gram").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return told.where(F.col("n") * share >= grams.count()).select("gram")


def _shared_grams(grams: DataFrame) -> DataFrame:
    """(doc_id, gram, phases): the grams that several texts chose, with the phases they have in any of them.

    Hot grams are few by proof; their phases are combined before they move, and
    come back by broadcast. All others are small groups after one shuffle.
    """
    hot = F.broadcast(materialize(_hot_grams(grams), "hot_grams"))
    of = Window.partitionBy("gram")
    cold = grams.join(hot, "gram", "left_anti").select("doc_id", "gram", F.count("*").over(of).alias("n"), F.bit_or("phases").over(of).alias("phases"))
    rows = grams.join(hot, "gram")
    combined = rows.groupBy("gram").agg(F.count("*").alias("n"), F.bit_or("phases").alias("phases"))
    warm = rows.select("doc_id", "gram").join(F.broadcast(combined), "gram").select("doc_id", "gram", "n", "phases")
    return cold.unionByName(warm).where("n > 1").drop("n")


def candidate_pairs(docs: DataFrame, least: int, block: int, gram: int) -> DataFrame:
    """(a, b): pairs of texts with a common index entry.

    The rows of a hot entry are shared out: each probing text goes to one of
    several tasks, and the entry's reference rows to all of them.
    """
    grams = materialize(_chosen_grams(docs, least, block, gram), "grams")
    shared = _shared_grams(grams)
    live = materialize(shared.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "phases")).alias("live")), "live_grams")
    entries = materialize(_entries(docs, live, least, block, gram), "entries")
    counts = entries.groupBy("entry").agg(F.count("*").alias("n"), F.bool_or("reference").alias("met"))
    shares = materialize(counts.where(F.col("met") & (F.col("n") > 1)).select("entry", F.ceil(F.col("n") / HOT_ENTRY).alias("shares")), "entries_met")
    probes = entries.join(shares, "entry").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")))
    index = entries.where("reference").join(shares, "entry").select("entry", F.col("doc_id").alias("r"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"))
    hits = probes.select("entry", "share", "doc_id").join(index, ["entry", "share"]).where(F.col("doc_id") != F.col("r"))
    return hits.select(F.least("doc_id", "r").alias("a"), F.greatest("doc_id", "r").alias("b")).distinct()


def _repeats(a: str, b: str, least: int, first: bool = False) -> list[tuple[int, int, int]]:
    """Maximal exact repeats (start in a, start in b, length) of at least ``least`` characters; with ``first`` one is enough.

    Fixed blocks of half the length index one text, every window of the other
    probes them, and hits are extended both ways.
    """
    size = max(1, (least + 1) // 2)
    index: dict[str, list[int]] = {}
    for s in range(0, len(a) - size + 1, size):
        index.setdefault(a[s : s + size], []).append(s)
    t = Texts([b])
    probes = t.rolling(size)
    blocks = Texts([a])
    starts = np.arange(0, len(a) - size + 1, size)
    hit = np.flatnonzero(np.isin(probes, blocks.at(starts, size)))
    found: set[tuple[int, int, int]] = set()
    seen: dict[int, int] = {}  # diagonal -> end in b of the repeat found last
    for p in hit.tolist():
        for s in index.get(b[p : p + size], ()):
            if seen.get(s - p, -1) > p:
                continue
            low = 0
            while low < min(s, p) and a[s - low - 1] == b[p - low - 1]:
                low += 1
            high, end = size, min(len(a) - s, len(b) - p)
            while high < end and a[s + high : s + high + 64] == b[p + high : p + high + 64] and high + 64 <= end:
                high += 64
            while high < end and a[s + high] == b[p + high]:
                high += 1
            seen[s - p] = p + high
            if low + high >= least:
                found.add((s - low, p - low, low + high))
                if first:
                    return list(found)
    return sorted(found)


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b")


def shared_span_pairs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, block: int = BLOCK, gram: int = GRAM) -> DataFrame:
    """(doc_id_a, doc_id_b): pairs, smaller id first, with a common run of at least ``least`` characters.

    Characters are code points of the text as it stands. Null texts, shorter
    texts and rows without id are in no pair. Rows that
    repeat an id are texts of the same document, which pairs with no copy of
    itself. Exact copies under different ids pair like any others.
    """
    if not (0 < block <= 62 and block < gram < least):
        raise ValueError("block < gram < least and block <= 62 must hold")
    docs = _documents(documents, id_column, text_column, least)
    pairs, texts = _candidates(docs, least, block, gram)

    def extend(batches):
        for pdf in batches:
            ok = [bool(_repeats(x, y, least, first=True)) for x, y in zip(pdf["text_a"], pdf["text_b"])]
            yield pdf.loc[ok, ["a", "b"]]

    # rows that repeat an id may tell the same pair more than once
    return _with_texts(pairs, texts).mapInPandas(extend, "a bigint, b bigint").distinct().toDF("doc_id_a", "doc_id_b")


def _candidates(docs: DataFrame, least: int, block: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The candidate pairs, and the texts that are in any of them."""
    pairs = materialize(candidate_pairs(docs, least, block, gram), "span_pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return pairs, materialize(docs.join(needed, "doc_id", "left_semi"), "span_texts")


def maximal_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, block: int = BLOCK, gram: int = GRAM) -> DataFrame:
    """(doc_id_a, start_a, doc_id_b, start_b, length): all maximal exact repeats of pairs that share a span.

    The same nulls, short texts and repeats as ``shared_span_pairs``.
    """
    docs = _documents(documents, id_column, text_column, least)
    pairs, texts = _candidates(docs, least, block, gram)

    def extend(batches):
        for pdf in batches:
            rows = [(a, s, b, t, n) for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]) for s, t, n in _repeats(x, y, least)]
            yield pd.DataFrame(rows, columns=["doc_id_a", "start_a", "doc_id_b", "start_b", "length"])

    return _with_texts(pairs, texts).mapInPandas(extend, "doc_id_a bigint, start_a bigint, doc_id_b bigint, start_b bigint, length bigint")


def shared_amounts(documents: DataFrame, repeats: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, partners): of each text with a shared span, how much of it occurs elsewhere.

    Overlapping spans count once: spans are ordered by start, and each adds what
    lies beyond all earlier ends.
    """
    both = repeats.select(F.col("doc_id_a").alias("doc_id"), F.col("start_a").alias("s"), "length", F.col("doc_id_b").alias("other")).unionByName(
        repeats.select(F.col("doc_id_b").alias("doc_id"), F.col("start_b").alias("s"), "length", F.col("doc_id_a").alias("other"))
    )
    both = materialize(both, "repeat_sides")
    spans = both.groupBy("doc_id", "s").agg(F.max(F.col("s") + F.col("length")).alias("e"))
    before = Window.partitionBy("doc_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("e").over(before), F.lit(0))
    new = spans.select("doc_id", F.greatest(F.col("e") - F.greatest("s", reach), F.lit(0)).alias("n"))
    amount = new.groupBy("doc_id").agg(F.sum("n").alias("shared_chars"))
    partners = both.groupBy("doc_id").agg(F.countDistinct("other").alias("partners"))
    size = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.char_length(text_column).cast("bigint").alias("n_chars"))
    return size.join(amount.join(partners, "doc_id"), "doc_id").select("doc_id", "n_chars", "shared_chars", "partners")


def all_amounts(documents: DataFrame, repeats: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``shared_amounts`` of all texts: those without a shared span, short and null ones too, have 0 shared_chars and 0 partners."""
    some = shared_amounts(documents, repeats, id_column, text_column).drop("n_chars")
    size = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.char_length(text_column).cast("bigint").alias("n_chars"))
    none = F.lit(0).cast("bigint")
    return size.join(some, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", none).alias("shared_chars"), F.coalesce("partners", none).alias("partners"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_span_pairs(table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, shared_chars, partners): one row per document, 0 and 0 where it shares nothing; n_chars is null with the text."""
    docs = table(spark, sf_dir, "documents")
    return all_amounts(docs, maximal_repeats(docs))


# Brute force: every window of 200 characters that occurs in several documents.
_WINDOWS_SQL = """
WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
s AS (SELECT doc_id, i, substr(text, i, 200) AS g FROM w),
k AS (SELECT DISTINCT doc_id, g FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(DISTINCT doc_id) > 1)),
p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.g = b.g AND a.doc_id <> b.doc_id)
"""
P8_FOUND_SQL = _WINDOWS_SQL + "SELECT a AS doc_id_a, b AS doc_id_b FROM p WHERE a < b"
P8_SHARED_SQL = (
    _WINDOWS_SQL
    + """, c AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM s WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM k)),
m AS (SELECT doc_id, sum(CASE WHEN n < i + 200 THEN n - i ELSE 200 END) AS shared FROM c GROUP BY doc_id), q AS (SELECT a AS doc_id, count(*) AS partners FROM p GROUP BY a)
SELECT d.doc_id, length(d.text) AS n_chars, CAST(coalesce(m.shared, 0) AS BIGINT) AS shared_chars, coalesce(q.partners, 0) AS partners FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN q USING (doc_id)
"""
)
