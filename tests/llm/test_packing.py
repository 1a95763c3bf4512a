import itertools
import random

import numpy as np
import pytest

from factmill.llm.packing import best_fit_decreasing, lower_bound, pack, pieces


def _exact(sizes, capacity):
    """Fewest containers, by trying all."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += sizes[i]
                go(i + 1, bins)
                bins[b] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_bound_never_exceeds_the_optimum_and_sometimes_beats_the_volume():
    r = random.Random(3)
    beats = 0
    for _ in range(250):
        capacity = r.choice([7, 10, 20, 100])
        sizes = sorted((r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 9))), reverse=True)
        bound, best = lower_bound(np.array(sizes), capacity), _exact(sizes, capacity)
        assert bound <= best, (sizes, capacity)
        where, fills = best_fit_decreasing(np.array(sizes), capacity)
        assert len(fills) >= best and fills.max() <= capacity and fills.sum() == sum(sizes)
        beats += bound > -(-sum(sizes) // capacity)
    assert beats > 20
    assert lower_bound(np.zeros(0, int), 10) == 0


def test_best_fit_takes_the_fullest_container():
    where, fills = best_fit_decreasing(np.array([6, 5, 4, 3, 0]), 10)
    assert fills.tolist() == [10, 8] and where.tolist()[:4] == [0, 1, 0, 1]


@pytest.mark.parametrize("partition_items", [5, 40, 10_000])
def test_every_piece_once_and_no_container_over_capacity(spark, partition_items):
    r = random.Random(5)
    sizes = [r.randrange(0, 260) for _ in range(150)] + [None, -3, 100, 200, 0]
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "item_id long, size long, piece string")
    caps = spark.createDataFrame([(1, 100), (2, 64), (2, 64), (3, None)], "capacity_id int, capacity int")
    got = pack(pieces(items, caps), partition_items=partition_items).collect()
    for cid, capacity in ((1, 100), (2, 64)):
        mine = [x for x in got if x.capacity_id == cid]
        fill = {}
        for x in mine:
            fill[x.container_id] = fill.get(x.container_id, 0) + x.size
        assert max(fill.values()) <= capacity
        for i, s in enumerate(sizes):
            parts = sorted((x.piece, x.size) for x in mine if x.item_id == i)
            assert [p for p, _ in parts] == list(range(len(parts))) and sum(n for _, n in parts) == max(s or 0, 0)
            assert len(parts) == max(1, -(-max(s or 0, 0) // capacity))  # none split unless longer
        volume = -(-sum(max(s or 0, 0) for s in sizes) // capacity)
        assert len(fill) <= 1.35 * volume + (150 / partition_items)
    assert {x.capacity_id for x in got} == {1, 2}


def test_hot_size_and_nothing(spark):
    caps = spark.createDataFrame([(1, 10)], "capacity_id int, capacity int")
    same = spark.createDataFrame([(i, 5) for i in range(60)], "item_id long, size long")
    assert pack(pieces(same, caps), partition_items=7).select("container_id").distinct().count() <= 33
    assert pack(pieces(same.limit(0), caps)).collect() == []


def test_order_of_rows_does_not_matter(spark):
    rows = [(i, (i * 37) % 90) for i in range(80)]
    caps = spark.createDataFrame([(1, 100)], "capacity_id int, capacity int")
    one, two = (sorted(map(tuple, pack(pieces(spark.createDataFrame(x, "item_id long, size long"), caps), partition_items=20).collect())) for x in (rows, rows[::-1]))
    assert one == two


def test_exhaustive_small():
    for sizes in itertools.product(range(1, 6), repeat=4):
        assert lower_bound(np.array(sizes), 5) <= _exact(sorted(sizes, reverse=True), 5)


def test_bound_tries_low_thresholds_among_many_sizes():
    # threshold 101: the large ones whole, all others by volume; 901 distinct sizes
    sizes = np.array([3996] * 500 + list(range(101, 1001)))
    assert lower_bound(sizes, 4096) == 500 + -(-sum(range(101, 1001)) // 4096)
