"""Filling fixed-capacity containers with items, by bound-certified repacking.

Items are hashed into partitions and packed best-fit decreasing. Dual-feasible
functions give each partition a lower bound on its containers: a partition that
meets its bound is certified and final. Partitions with a gap exchange the items
of their unfilled containers and are packed again, mixed anew, until a bound over all
items certifies the whole or exchanging saves nothing more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.io import materialize, table
from factmill.llm.tokenizer import VOCABULARY, token_counts

PARTITION_ITEMS = 20_000
PATIENCE = 2  # rounds without gain after which a capacity is closed
MOST_CAPACITIES = 1_000
FUNCTIONS = 256  # u(k) of greater k come ever closer to the plain volume

_PACKED = "capacity_id int, capacity bigint, part bigint, bin bigint, item_id bigint, piece bigint, size bigint, fill bigint, gap bigint"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that sizes (1 .. capacity) need at least: the best of three families of dual-feasible functions.

    f0 drops items below a threshold t and counts those above capacity - t
    whole; f1 is the family u(k), which rounds (k + 1) x / capacity down where it
    is no integer; f2 counts the items over half the capacity. Any of them,
    summed, is at most 1 over one container.
    """
    return lower_bound_counts(*np.unique(sizes, return_counts=True), capacity)


def lower_bound_counts(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of distinct sizes with the number of items of each."""
    if not len(sizes):
        return 0
    count = np.zeros(capacity + 1, np.int64)
    count[sizes] = counts
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    many, volume = np.cumsum(count), np.cumsum(count * x)
    t = np.unique(np.minimum(sizes, capacity // 2))
    t = t[t > 0]
    if len(t):
        # f0 with threshold t: whole containers for x > capacity - t, x itself for t <= x <= capacity - t
        whole = many[-1] - many[capacity - t]
        middle = volume[capacity - t] - volume[t - 1]
        best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, min(FUNCTIONS, max(1, capacity // int(sizes.min()))) + 1):
        y = (k + 1) * x
        f = np.where(y % capacity == 0, y * k // (k + 1), (y // capacity) * capacity)  # times capacity * k
        best = max(best, -(-int((count * f).sum()) // (capacity * k)))
    return max(best, int(many[-1] - many[capacity // 2]))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of every item, fill of every container); items of size 0 go to the first container."""
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    stacks: dict[int, list[int]] = {}
    rooms = 0  # bit r: some container has room r
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        fills[b] += s
        room -= s
        where[i] = b
        if room or not s:
            stacks.setdefault(room, []).append(b)
            rooms |= 1 << room
    return where, np.array(fills, np.int64)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["item_id", "piece"], kind="stable")
    sizes = pdf["size"].to_numpy(np.int64)
    where, fills = best_fit_decreasing(sizes, capacity)
    gap = len(fills) - max(lower_bound(sizes[sizes > 0], capacity), 1)
    return pdf.assign(bin=where, fill=fills[where], gap=gap)[[c.split()[0] for c in _PACKED.split(", ")]]


def pieces(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, capacity, item_id, piece, size): every item for every capacity, cut only where it is longer.

    A longer item gives full pieces and a rest. Null and negative sizes count as 0.
    """
    caps = capacities.select(F.col("capacity_id").cast("int").alias("capacity_id"), F.col("capacity").cast("bigint").alias("capacity")).where("capacity > 0").distinct()
    # The capacities are a parameter list, so each item can carry them all.
    given = caps.limit(MOST_CAPACITIES + 1).collect()
    if len(given) > MOST_CAPACITIES:
        raise ValueError(f"at most {MOST_CAPACITIES} capacities can be given")
    total = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("bigint").alias("total")
    listed = F.array(*[F.struct(F.lit(c.capacity_id).alias("capacity_id"), F.lit(c.capacity).cast("bigint").alias("capacity")) for c in given])
    both = items.select("item_id", total, F.explode(listed.cast("array<struct<capacity_id:int,capacity:bigint>>")).alias("c")).select("item_id", "total", "c.*")
    last = F.greatest(F.ceil(F.col("total") / F.col("capacity")) - 1, F.lit(0))
    cut = both.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return cut.select("capacity_id", "capacity", "item_id", "piece", F.least(F.col("capacity"), F.col("total") - F.col("piece") * F.col("capacity")).alias("size"))


def bounds(cut: DataFrame) -> DataFrame:
    """(capacity_id, capacity, tokens, pieces, least): of each capacity the bound over all pieces."""
    # The bound needs only how often each size occurs: at most `capacity` rows per capacity.
    sizes = cut.groupBy("capacity_id", "capacity", "size").agg(F.count("*").alias("n"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        at = pdf[pdf["size"] > 0]
        least = lower_bound_counts(at["size"].to_numpy(np.int64), at["n"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"capacity_id": pdf["capacity_id"].iloc[:1], "capacity": capacity, "tokens": int((pdf["size"] * pdf["n"]).sum()), "pieces": int(pdf["n"].sum()), "least": max(least, 1)})

    return sizes.groupBy("capacity_id").applyInPandas(bound, "capacity_id int, capacity bigint, tokens bigint, pieces bigint, least bigint")


def pack(cut: DataFrame, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """(capacity_id, container_id, item_id, piece, size) of ``pieces``: no container over its capacity, every piece once.

    Pieces that fill a container are placed alone at once. The rest goes through
    rounds of certified repacking, in partitions of about ``partition_items``. A
    round is kept for the capacities whose containers it made fewer; a capacity
    is done when the bound over all its pieces is met, when one partition holds
    all that is left, or after ``PATIENCE`` rounds that saved nothing.
    Ties in size are broken by item and piece, so the
    result doesn't depend on the order of rows. Empty input gives an empty result.
    """
    full = cut.where(F.col("size") == F.col("capacity")).select(
        "capacity_id", F.concat_ws("-", F.lit("full"), F.col("item_id"), F.col("piece")).alias("container_id"), "item_id", "piece", "size"
    )
    columns = full.columns
    # What comes to the driver is a row per capacity.
    least = {b.capacity_id: b.least for b in bounds(cut).select("capacity_id", "least").collect()}
    used: dict[int, int] = dict(full.groupBy("capacity_id").count().collect())
    rest = materialize(cut.where(F.col("size") < F.col("capacity")), "unplaced")
    closed, kept, waited, r = [full], None, dict.fromkeys(least, 0), 0
    while True:
        left = dict(rest.groupBy("capacity_id").count().collect())
        if not left:
            break
        parts = {c: -(-n // partition_items) for c, n in left.items()}
        number = F.create_map(*[F.lit(x) for c, n in parts.items() for x in (c, n)])[F.col("capacity_id")]
        packed = rest.withColumn("part", F.pmod(F.xxhash64("item_id", "piece", F.lit(r)), number))
        packed = materialize(packed.groupBy("capacity_id", "part").applyInPandas(_pack, _PACKED).withColumn("container_id", F.concat_ws("-", F.lit(r), "part", "bin")), f"pack{r}")
        bins = _bins(packed)
        if kept is not None:  # where nothing was saved, what was packed before holds
            worse = [c for c, b in bins.items() if b >= before[c]]
            waited.update({c: waited[c] + 1 for c in worse})
            packed = packed.where(~F.col("capacity_id").isin(worse)).unionByName(kept.where(F.col("capacity_id").isin(worse)))
            bins.update({c: before[c] for c in worse})
        over = [c for c, b in bins.items() if parts[c] == 1 or used.get(c, 0) + b <= least[c] or waited[c] >= PATIENCE]
        final = (F.col("gap") <= 0) | (F.col("fill") == F.col("capacity")) | F.col("capacity_id").isin(over)
        done, kept = materialize(packed.where(final), f"placed{r}"), materialize(packed.where(~final), f"unfilled{r}")
        closed.append(done.select(*columns))
        for c, b in _bins(done).items():
            used[c] = used.get(c, 0) + b
        before = _bins(kept)
        rest, r = kept.select("capacity_id", "capacity", "item_id", "piece", "size"), r + 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def _bins(packed: DataFrame) -> dict[int, int]:
    return dict(packed.groupBy("capacity_id").agg(F.count_distinct("container_id")).collect())


def _packed(spark: SparkSession, sf_dir: str, path: str) -> tuple[DataFrame, DataFrame]:
    counts = token_counts(table(spark, sf_dir, "documents"), path=path)
    items = materialize(counts.select(F.col("doc_id").alias("item_id"), F.col("tokens").alias("size")), "token_counts")
    caps = table(spark, sf_dir, "pack_capacities").select("capacity_id", F.col("capacity_tokens").alias("capacity"))
    cut = pieces(items, caps)
    return cut, pack(cut)


def p7_containers(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece, tokens): where every document, or piece of a longer one, is put.

    Documents without tokens (empty, null) are put too, with 0 tokens.
    """
    _, packed = _packed(spark, sf_dir, path)
    return packed.select("capacity_id", "container_id", F.col("item_id").alias("doc_id"), "piece", F.col("size").alias("tokens"))


def p7_report(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    """(capacity_id, capacity, pieces, tokens, containers, least, unused, certified): of each capacity, with the bound over all pieces.

    ``certified`` says that no packing needs fewer containers.
    """
    cut, packed = _packed(spark, sf_dir, path)
    used = packed.groupBy("capacity_id").agg(F.countDistinct("container_id").alias("containers"))
    unused = F.col("containers") * F.col("capacity") - F.col("tokens")
    return bounds(cut).join(used, "capacity_id").select("capacity_id", "capacity", "pieces", "tokens", "containers", "least", unused.alias("unused"), (F.col("containers") <= F.col("least")).alias("certified"))


def p7_checks(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    """(capacity_id, documents, lost, split, overfull): documents that are placed, those whose pieces aren't all their tokens, those split without need, containers over their capacity."""
    cut, packed = _packed(spark, sf_dir, path)
    size = cut.groupBy("capacity_id", "capacity", "item_id").agg(F.sum("size").alias("tokens"))
    placed = packed.groupBy("capacity_id", "item_id").agg(F.sum("size").alias("placed"), F.count("*").alias("n"), F.count_distinct("piece").alias("pieces"))
    each = size.join(placed, ["capacity_id", "item_id"], "left")
    whole = F.coalesce((F.col("placed") == F.col("tokens")) & (F.col("n") == F.col("pieces")), F.lit(False))
    documents = each.groupBy("capacity_id", "capacity").agg(F.count("placed").alias("documents"), F.count_if(~whole).alias("lost"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("split"))
    fills = packed.groupBy("capacity_id", "container_id").agg(F.sum("size").alias("fill"))
    over = fills.join(documents.select("capacity_id", "capacity"), "capacity_id").groupBy("capacity_id").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"))
    return documents.drop("capacity").join(over, "capacity_id")


P7_CHECKS_SQL = "SELECT capacity_id, (SELECT count(*) FROM documents) AS documents, 0 AS lost, 0 AS split, 0 AS overfull FROM pack_capacities"
