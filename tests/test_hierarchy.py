import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import hierarchy

SCHEMA = "element_id string, parent_id string, recorded_at timestamp_ntz, deleted_at timestamp_ntz, v string, j string"


def brute(parent):
    """{key: (path from the root, or None, the smallest key of the cycle, whether on it)}"""
    out = {}
    for key in parent:
        path, seen, at = [], set(), key
        while at in parent and at not in seen:
            seen.add(at)
            path.append(at)
            at = parent[at]
        if at in seen:
            ring = path[path.index(at):]
            out[key] = (None, min(ring), key in ring)
        else:
            out[key] = (path[::-1], None, False)
    return out


def rows(parent):
    return [(k, p, None, None, "x", "y") for k, p in parent.items()]


def check(spark, parent):
    nodes = hierarchy.parent_rows(spark.createDataFrame(rows(parent), SCHEMA), "element_id", "parent_id", "recorded_at")
    want = brute(parent)
    cyc = {r.v: (r.cycle_id, r.place) for r in hierarchy.cycles(nodes).collect()}
    assert cyc == {k: (c, "on" if on else "under") for k, (_, c, on) in want.items() if c is not None}
    got = {r.v: r for r in hierarchy.hierarchy(nodes).collect()}
    assert set(got) == {k for k, (p, _, _) in want.items() if p is not None}
    below = {k: {x for x, (p, _, _) in want.items() if p and k in p[:-1]} for k in got}
    for k, r in got.items():
        path = want[k][0]
        assert (r.path, r.root, r.depth, r.descendants) == ("/".join(path), path[0], len(path) - 1, len(below[k]))
        assert {x for x, o in got.items() if o.root == r.root and r.start < o.start < r.stop} == below[k]
    assert len({(r.root, r.start) for r in got.values()}) == len(got)


def test_random_forests_with_cycles(spark):
    rnd = random.Random(7)
    parent = {}
    for n in range(120):
        parent[f"n{n:03d}"] = rnd.choice([None, "", f"n{rnd.randrange(120):03d}", f"n{max(0, n - 1):03d}", "gone"])
    check(spark, {k: p or None for k, p in parent.items()})


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed, monkeypatch):
    """Deep, wide and mixed trees, with siblings in many buckets."""
    monkeypatch.setattr(hierarchy, "SIBLINGS", 2)
    rnd = random.Random(seed)
    reach = (3, 40, 150)[seed]
    check(spark, {f"n{n:03d}": f"n{rnd.randrange(max(0, n - reach), n):03d}" if n and rnd.random() < 0.97 else None for n in range(150)})


def test_long_chain(spark):
    """A chain of 100,000 rows with a leaf at each: positions without paths."""
    n = 100_000
    k = F.col("id")
    df = spark.range(2 * n).select(F.format_string("n%07d", k).alias("v"), F.when(k >= n, F.format_string("n%07d", k - n)).when(k > 0, F.format_string("n%07d", k - 1)).alias("p"))
    out = hierarchy.hierarchy(df, paths=False)
    got = out.agg(F.count("*"), F.max("depth"), F.max("descendants"), F.countDistinct("start"), F.max("stop"), F.sum(F.col("stop") - F.col("start") - 1), F.sum("depth"), F.countDistinct("root")).first()
    assert tuple(got) == (2 * n, n, 2 * n - 1, 2 * n, 2 * n, got[6], n * (n - 1) // 2 + n * (n + 1) // 2, 1)


def test_chain_star_and_rings(spark):
    parent = {f"c{n:02d}": f"c{n - 1:02d}" if n else None for n in range(40)}
    parent |= {f"s{n:02d}": "c00" for n in range(30)}
    parent |= {"r1": "r2", "r2": "r3", "r3": "r1", "u1": "r2", "u2": "u1", "self": "self", "under": "self"}
    check(spark, parent)


def test_earliest_row_empty_and_null_keys(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([("a", "b", at(2), None, "", ""), ("a", None, at(1), None, "", ""), (None, "a", at(1), None, "", ""), ("a", None, at(1), None, "", ""), ("b", "", at(1), at(1), "", "")], SCHEMA)
    nodes = hierarchy.parent_rows(df, "element_id", "parent_id", "recorded_at")
    assert {r.v: r.p for r in nodes.collect()} == {"a": None, "b": None}
    assert hierarchy.cycles(nodes).count() == 0
    none = hierarchy.parent_rows(df.limit(0), "element_id", "parent_id", "recorded_at")
    assert hierarchy.cycles(none).count() == 0 and hierarchy.hierarchy(none).count() == 0
