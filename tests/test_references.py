import datetime as dt
import random

import pytest

from docspark.operators import references

at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


@pytest.mark.parametrize("salts", [1, 4])
def test_against_brute_force(spark, salts):
    rnd = random.Random(salts)
    parents = [(rnd.choice(["a", "b", "c", "d", None]), at(rnd.randrange(20)), rnd.choice([None, at(rnd.randrange(30))])) for _ in range(12)]
    refs = [(n, rnd.choice(["a", "b", "c", "d", "e", "", None]), rnd.choice([None, at(rnd.randrange(30))]), "k") for n in range(80)]
    refs += [(100, "e", at(1), "k")] * 2  # repeated rows stay
    valid = references.validity(spark.createDataFrame(parents, "element_id string, recorded_at timestamp_ntz, deleted_at timestamp_ntz"), "element_id")
    df = spark.createDataFrame(refs, "n int, element_id string, at timestamp_ntz, key string")
    got = sorted((r.n, r.element_id, r.key, r.reason) for r in references.orphans(df, valid, "element_id", "at", salts).collect())
    want = []
    for n, key, t, k in refs:
        own = [p for p in parents if p[0] == key]
        if not key:
            continue
        deleted = min((p[2] for p in own if p[2]), default=None)
        if not own:
            want.append((n, key, k, "missing"))
        elif deleted and t and deleted <= t:
            want.append((n, key, k, "deleted"))
        elif t and min(p[1] for p in own) > t:
            want.append((n, key, k, "late"))
    assert got == sorted(want)


def test_empty(spark):
    valid = references.validity(spark.createDataFrame([], "element_id string, recorded_at timestamp_ntz, deleted_at timestamp_ntz"), "element_id")
    df = spark.createDataFrame([("x", None)], "element_id string, at timestamp_ntz")
    assert [r.reason for r in references.orphans(df, valid, "element_id", "at").collect()] == ["missing"]
    assert references.orphans(df.limit(0), valid, "element_id", "at").count() == 0
