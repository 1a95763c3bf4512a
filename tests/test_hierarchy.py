import random

import pytest

from factmill.operators.hierarchy import ancestor_paths, class_links, descendants, resolve_forest

BIG = 2**62  # ids that floats can't hold


def brute(parent):
    out = {}
    for n in parent:
        path, seen, at = [n], {n}, n
        while True:
            up = parent.get(at)
            if up is None or up not in parent:
                out[n] = (path[-1], len(path) - 1, path[::-1])
                break
            if up in seen:
                loop, x = [up], parent[up]
                while x != up:
                    loop.append(x)
                    x = parent[x]
                out[n] = (min(loop), -1, None)
                break
            path.append(up)
            seen.add(up)
            at = up
    return out


@pytest.mark.parametrize("fragment_rows", [1000, 7])
@pytest.mark.parametrize("shape", ["random", "path", "loops"])
def test_against_brute_force(spark, fragment_rows, shape):
    r = random.Random(f"{shape}{fragment_rows}")
    n = 40
    ids = [BIG + i * 3 for i in range(n)]
    if shape == "path":
        parent = {ids[i]: (ids[i - 1] if i else None) for i in range(n)}
    elif shape == "random":
        parent = {ids[i]: (ids[r.randrange(i)] if i and r.random() < 0.9 else None) for i in range(n)}
        parent[ids[5]] = 17  # names no node
    else:
        parent = {i: r.choice(ids) for i in ids}
    links = spark.createDataFrame([(i, p, r.choice([1, 2, None])) for i, p in parent.items()], "id long, parent long, local long")
    got = {x.id: (x.root, x.depth, x.path and list(x.path)) for x in resolve_forest(links, fragment_rows=fragment_rows, with_path=True).collect()}
    assert got == brute(parent)
    plain = {x.id: (x.root, x.depth) for x in resolve_forest(links, fragment_rows=fragment_rows).collect()}
    assert plain == {k: v[:2] for k, v in brute(parent).items()}


def test_empty(spark):
    assert resolve_forest(spark.createDataFrame([], "id long, parent long, local long")).collect() == []


def test_descendants(spark, rows):
    links = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 2, 0), (4, 4, 0)], "id long, parent long, local long")
    assert rows(descendants(resolve_forest(links, with_path=True))) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_class_links_latest_scan_and_spelling(spark, rows):
    data = [
        (1, "p", "App\\A", None, "2024-01-02", "x"),
        (2, "p", "App\\B", " \\app\\a\t", "2024-01-02", "x"),
        (2, "p", "App\\B", "App\\C", "2024-01-01", "x"),  # an older scan
        (2, "p", "App\\B", " \\app\\a\t", "2024-01-02", "x"),  # a repeat
        (3, "q", "App\\C", "App\\A", "2024-01-02", "x"),  # the parent is of another project
        (4, None, "App\\D", None, None, "x"),
        (5, "p", None, "App\\A", None, "x"),
    ]
    classes = spark.createDataFrame(data, "class_id long, project_id string, fqcn string, extends string, scanned_at string, id string")
    assert rows(class_links(classes), "class_id", "parent_id") == [(1, None), (2, 1), (3, None)]


@pytest.mark.parametrize("fragment_rows", [1000, 3])
def test_chains_on_and_below_loops(spark, rows, fragment_rows):
    # a tree, a loop 30 -> 10 -> 20 -> 30 with chains below two members, a node that names itself with one below
    parent = {1: None, 2: 1, 10: 20, 20: 30, 30: 10, 41: 20, 42: 41, 43: 42, 51: 10, 60: 60, 61: 60}
    links = spark.createDataFrame([(i, p, i % 2) for i, p in parent.items()], "id long, parent long, local long")
    paths = {x.id: (x.root, x.depth, list(x.path)) for x in ancestor_paths(links, fragment_rows).collect()}
    assert paths[1] == (1, 0, [1]) and paths[2] == (1, 1, [1, 2])
    assert paths[10] == (10, -1, [30, 20, 10])
    assert {i: p[2] for i, p in paths.items()} == {i: climb(parent, i) for i in parent}
    assert paths[43][:2] == (10, -1) and paths[61] == (60, -1, [60, 61])
    got = rows(descendants(ancestor_paths(links, fragment_rows)))
    assert got == sorted(((a, i, n) for i in parent for n, a in enumerate(climb(parent, i)[::-1]) if n), key=str)
    assert (41, 43, 2) in got and (42, 43, 1) in got  # on no loop, below one


def climb(parent, at):
    path = []
    while at is not None and at not in path:
        path.insert(0, at)
        at = parent[at]
    return path
