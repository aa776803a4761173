import json
import random

from docspark.operators import nesting

LONE, PARSED = ("spans", "notes"), (("elements", "metadata"),)


def brute(payload):
    """(path, parent path) of objects in arrays, by plain recursion."""
    out = []

    def go(value, path, parent, listed):
        if isinstance(value, dict):
            for k, v in value.items():
                if k == "metadata" and listed == "elements" and isinstance(v, str):
                    try:
                        v = json.loads(v) if isinstance(json.loads(v), dict) else v
                    except ValueError:
                        pass
                if k in LONE and isinstance(v, dict):
                    v = [v]
                go(v, f"{path}.{k}" if path else k, parent, None)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                here = f"{path}[{i}]"
                if isinstance(v, dict):
                    out.append((here, parent))
                    go(v, here, here, path)
                else:
                    go(v, here, parent, None)

    go(json.loads(payload), "", "", None)
    return out


def grow(rnd, depth):
    if depth == 0:
        return rnd.choice([1, "x", None, True, 1.5, "é😀"])
    kind = rnd.randrange(3)
    if kind == 0:
        return [grow(rnd, depth - 1) for _ in range(rnd.randrange(3))]
    return {rnd.choice(["a", "spans", "notes", "metadata", "elements"]): grow(rnd, depth - 1) for _ in range(rnd.randrange(1, 4))}


def test_paths_against_recursion(spark):
    rnd = random.Random(3)
    payloads = [json.dumps({"elements": [grow(rnd, 5), {"metadata": json.dumps(grow(rnd, 4)), "notes": {"x": 1}}], "z": grow(rnd, 5)}) for _ in range(40)]
    rows = [(n, p, "clash") for n, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "raw_id long, payload string, node_path string")
    got = sorted((r.record, r.node_path, r.parent_path) for r in nesting.flatten(df, "raw_id", "payload", LONE, PARSED).collect() if r.parent_path is not None)
    assert got == sorted((n, *x) for n, p in enumerate(payloads) for x in brute(p))


def test_identical_objects_once(spark):
    a, b = {"k": [{"x": 1, "y": [{"z": 2}]}, {"y": [{"z": 2}], "x": 1}]}, {"q": [{"z": 2}]}
    df = spark.createDataFrame([(1, json.dumps(a)), (2, json.dumps(b)), (3, None), (4, "no json"), (5, "[{\"z\": 2}]"), (6, "\"\\ud800\"")], "raw_id long, payload string")
    rows = nesting.flatten(df, "raw_id", "payload")
    by = {(r.record, r.node_path): r for r in rows.collect()}
    assert by[1, "k[0]"].node_hash == by[1, "k[1]"].node_hash
    assert len({by[1, "k[0].y[0]"].node_hash, by[1, "k[1].y[0]"].node_hash, by[2, "q[0]"].node_hash}) == 1
    assert by[1, "k[0].y[0]"].parent_path == "k[0]" and by[1, "k[1]"].ordinal == 1 and by[1, "k[0].y[0]"].depth == 2
    assert {r.node_hash: r.occurrences for r in nesting.stored_objects(rows).collect()}[by[2, "q[0]"].node_hash] == 4
    assert (5, "[0]") in by and (6, "") in by and not any(k[0] in (3, 4) for k in by)


def test_deep_and_empty(spark):
    deep = "[" * 3000 + "{}" + "]" * 3000
    df = spark.createDataFrame([(1, "{}"), (2, deep)], "raw_id long, payload string")
    assert sorted(r.record for r in nesting.flatten(df, "raw_id", "payload").collect())[0] == 1
    assert nesting.flatten(df.limit(0), "raw_id", "payload").count() == 0


def test_any_depth(spark):
    """Arrays of 200,000 levels and objects of 3,000 levels are read; only what is no JSON is listed."""
    arrays, objects = "[" * 200_000 + "]" * 200_000, '{"k": [' * 3000 + "{}" + "]}" * 3000
    bad = ["no json", arrays[:-1], arrays + "]", "[1,]", '{"a" 1}', '{"a": 1,}', "[1 2]", "{1: 2}", "", "[" * 200_000 + "x"]
    df = spark.createDataFrame([(1, "{}"), (2, arrays), (3, objects), (4, None), (5, f'{{"x": [{{"y": {arrays}, "z": 1}}]}}')] + [(10 + n, p) for n, p in enumerate(bad)], "raw_id long, payload string")
    assert {r.record for r in nesting.unreadable(df, "raw_id", "payload").collect()} == {10 + n for n in range(len(bad))}
    rows = nesting.flatten(df, "raw_id", "payload").groupBy("record").count().collect()
    assert {r.record: r["count"] for r in rows} == {1: 1, 2: 1, 3: 3001, 5: 2}


def test_reader_and_writer_of_any_depth(monkeypatch):
    """Where the library's recurse too deep, the own ones give what the library would."""
    def deep(*args, **more):
        if not args or isinstance(args[0], dict | list) or more.get("stop"):
            raise RecursionError
        return real(*args, **more)

    rnd, real = random.Random(8), json.dumps
    values = [grow(rnd, 6) for _ in range(200)] + [[], {}, [[], {}], {"": [None, -1.5e-7, 12, "\\\"\n\u2028"]}, 7, "x", None]
    texts = [(v, real(v), real(v, indent=1), real(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for v in values]
    monkeypatch.setattr(json, "dumps", deep)
    assert all(nesting.dumps(v) == canonical for v, _, _, canonical in texts)
    monkeypatch.setattr(json, "loads", lambda text: (_ for _ in ()).throw(RecursionError))
    assert all(nesting.loads(a) == nesting.loads(b) == v for v, a, b, _ in texts)
    for text in ("", "[", "{", "[1,]", "nul", "1 2", '{"a":}', "]", "-", '"x'):
        try:
            assert nesting.loads(text) is NotImplemented, text
        except ValueError:
            pass


def test_rows_come_from_the_stored_objects():
    """Equal objects of a record are stored once, and the occurrences are read off the store."""
    store = nesting.Store()
    root = nesting.stored(json.dumps({"k": [{"x": 1, "y": [{"z": 2}]}] * 3}), frozenset(), frozenset(), store)
    assert len(store.objects) == 3 and [o[0] for o in store.occurrences(root)] == ["", "k[0]", "k[0].y[0]", "k[1]", "k[1].y[0]", "k[2]", "k[2].y[0]"]
    leaf = next(h for h, (fields, below) in store.objects.items() if not below)
    store.objects[leaf] = ('{"z":2}', [(".w", 4, leaf[::-1])])
    store.objects[leaf[::-1]] = ("{}", [])
    assert "k[2].y[0].w[4]" in [o[0] for o in store.occurrences(root)]
