"""Deeply nested JSON records as related flat tables.

Objects are canonicalised and hashed bottom-up (a Merkle tree: the hash of an object covers the hashes of what it holds), so
identical objects are stored once however often and wherever they occur. A bridge row for each occurrence keeps its record,
path, ordinal and parent; nothing else of the nesting is needed to rebuild the record.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OCCURRENCES = "record long, node_path string, parent_path string, list_path string, ordinal int, depth int, node_hash string, parent_hash string, fields string"
COLUMNS = [x.split()[0] for x in OCCURRENCES.split(", ")]
KINDS = [pa.int64(), *[pa.string()] * 3, pa.int32(), pa.int32(), *[pa.string()] * 3]


#: Characters that JSON allows between its tokens, and the numbers and names it knows.
_SPACE, _NUMBER = re.compile(r"[ \t\n\r]*"), re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?")
_NAMES = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def loads(text: str) -> object:
    """`json.loads` that reads any depth: where the library's reader recurses too deep, a stack of open containers does."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    top: list = []
    open_: list[tuple[object, str | None]] = [(top, None)]  # containers, each with the key that waits for a value
    at, wants = 0, "value"

    def put(value: object) -> None:
        where, key = open_[-1]
        if isinstance(where, list):
            where.append(value)
        else:
            where[key] = value

    while True:
        at = _SPACE.match(text, at).end()
        if len(open_) == 1 and wants == "next":
            break
        c = text[at : at + 1]
        inside = open_[-1][0]
        if wants in ("value", "first") and c in ("{", "["):
            value: object = {} if c == "{" else []
            put(value)
            open_.append((value, None))
            at, wants = at + 1, "first key" if c == "{" else "first"
        elif wants in ("next", "first", "first key") and c in ("}", "]") and (c == "}") == isinstance(inside, dict):
            open_.pop()
            at, wants = at + 1, "next"
        elif wants == "next" and c == ",":
            at, wants = at + 1, "key" if isinstance(inside, dict) else "value"
        elif wants in ("key", "first key") and c == '"':
            key, at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            open_[-1] = (inside, key)
            at, wants = at + 1, "value"
        elif wants in ("value", "first"):
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            elif name := next((n for n in _NAMES if text.startswith(n, at)), None):
                value, at = _NAMES[name], at + len(name)
            elif m := _NUMBER.match(text, at):
                value, at = (float(m.group(0)) if m[2] or m[3] else int(m.group(0))), m.end()
            else:
                raise ValueError(f"no value at {at}")
            put(value)
            wants = "next"
        else:
            raise ValueError(f"no {wants} at {at}")
    if at != len(text):
        raise ValueError(f"more after the value at {at}")
    return top[0]


def dumps(value: object, ascii_only: bool = False) -> str:
    """`json.dumps` in canonical form (sorted keys, no space) of any depth."""
    try:
        return json.dumps(value, ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[object] = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Raw):
            out.append(x)
        elif isinstance(x, dict):
            parts = [p for k in sorted(x) for p in (_Raw(f"{json.dumps(k, ensure_ascii=ascii_only)}:"), x[k], _Raw(","))]
            todo += reversed([_Raw("{"), *parts[:-1], _Raw("}")])
        elif isinstance(x, list):
            todo += reversed([_Raw("["), *[p for v in x for p in (v, _Raw(","))][:-1], _Raw("]")])
        else:
            out.append(json.dumps(x, ensure_ascii=ascii_only))
    return "".join(out)


#: Levels and digits of a number that `plain` leaves as they are: readers that recurse take at least as many.
LEVELS, DIGITS = 500, 900


def plain(text: str | None) -> str | None:
    """JSON in a form that any reader takes: of a name given twice the first value, what is nested deeper than LEVELS and numbers of more
    than DIGITS digits as text. None if it is no JSON."""
    if text is None:
        return None

    def number(kind: type):
        return lambda s: kind(s) if len(s) <= DIGITS else s

    def refuse(name: str):
        raise ValueError(name)

    try:
        try:
            value = json.loads(text, object_pairs_hook=lambda pairs: dict(reversed(pairs)), parse_int=number(int), parse_float=number(float), parse_constant=refuse)
        except RecursionError:
            value = loads(text)
        todo = [(value, 1)]
        while todo:
            x, depth = todo.pop()
            for k, v in list(x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()):
                if not isinstance(v, (dict, list)):
                    if isinstance(v, int) and not isinstance(v, bool) and v.bit_length() > 3 * DIGITS:
                        x[k] = dumps(v)
                elif depth >= LEVELS:
                    x[k] = dumps(v)
                else:
                    todo.append((v, depth + 1))
        return json.dumps(value)
    except (ValueError, RecursionError):
        return None


class _Raw(str):
    """Text that `dumps` takes over as it stands."""


def _text(value: object) -> str:
    text = dumps(value)
    try:
        text.encode()
    except UnicodeEncodeError:  # lone surrogates stay escaped
        text = dumps(value, True)
    return text


class Store:
    """Distinct objects by Merkle identity: (own fields as JSON, [(where in it, ordinal, identity)] of the objects below it)."""

    def __init__(self):
        self.objects: dict[str, tuple[str, list[tuple[str, int, str]]]] = {}

    def add(self, own: dict, below: list[tuple[str, int, str]]) -> str:
        """The identity of an object: the hash of its fields and of the places and identities of the objects below it."""
        fields, below = _text(own), sorted(below)
        identity = hashlib.sha256(f"[{fields},{_text([list(x) for x in below])}]".encode("utf-8", "surrogatepass")).hexdigest()
        self.objects.setdefault(identity, (fields, below))
        return identity

    def occurrences(self, root: str) -> Iterator[tuple]:
        """(node_path, parent_path, list_path, ordinal, depth, hash, parent's hash, own fields as JSON) of an object and all below it,
        which nothing but the stored objects says."""
        todo: list[tuple] = [("", None, None, None, 0, root, None)]
        while todo:
            node = todo.pop()
            fields, below = self.objects[node[5]]
            yield (*node, fields)
            for where, i, identity in reversed(below):
                todo.append((f"{node[0]}{where}[{i}]", node[0], f"{node[0]}{where}", i, node[4] + 1, identity, node[5]))


def stored(payload: str, lone: frozenset[str], parsed: frozenset[tuple[str, str]], store: Store) -> str:
    """Stores a record's objects bottom-up and gives the identity of the record itself, from which `Store.occurrences` goes on.

    A node is an object that is an entry of an array; the record itself is the node with the empty path. Under a key of
    `lone`, an object in place of an array is its only entry. A pair (list, key) of `parsed` names a key of that list's entries
    under which a string holding a JSON object is read as that object. Stacks are explicit, so depth is bounded by memory alone.
    """
    record = loads(payload)
    if not isinstance(record, dict):
        record = {"": record}
    nodes: list[tuple[int, str, int, dict, list]] = [(-1, "", 0, {}, [])]  # parent, list path in the parent, ordinal, own fields, objects below
    stack: list[tuple] = [(record, None, 0, nodes[0][3], None)]  # value, way to it from its node as linked pieces, the node, container to fill, key in it
    while stack:
        value, way, at, into, key = stack.pop()
        if isinstance(value, dict):
            own = into if key is None else {}
            if key is not None:
                into[key] = own
            for k, v in value.items():
                if isinstance(v, str) and own is nodes[at][3] and nodes[at][0] == 0 and (nodes[at][1], k) in parsed:
                    try:
                        inner = loads(v)
                        v = inner if isinstance(inner, dict) else v
                    except ValueError:
                        pass
                if k in lone and isinstance(v, dict):
                    v = [v]
                stack.append((v, (way, f".{k}" if at or way else k), at, own, k))
        elif isinstance(value, list):
            own = into[key] = [None] * len(value)
            where = None
            for i, v in enumerate(value):
                if isinstance(v, dict):
                    where = spelled(way) if where is None else where
                    nodes.append((at, where, i, {}, []))
                    own[i] = {"$": 0}
                    stack.append((v, None, len(nodes) - 1, nodes[-1][3], None))
                else:
                    stack.append((v, (way, f"[{i}]"), at, own, i))
        else:
            into[key] = value
    for n in range(len(nodes) - 1, 0, -1):  # a child always follows its parent
        parent, where, i, own, below = nodes[n]
        nodes[parent][4].append((where, i, store.add(own, below)))
    return store.add(nodes[0][3], nodes[0][4])


def spelled(way: tuple | None) -> str:
    pieces = []
    while way is not None:
        way, piece = way
        pieces.append(piece)
    return "".join(reversed(pieces))


def walk(payload: str, lone: frozenset[str], parsed: frozenset[tuple[str, str]]) -> Iterator[tuple]:
    """The occurrences of one record's objects."""
    store = Store()
    return store.occurrences(stored(payload, lone, parsed, store))


def flatten(df: DataFrame, record: str, payload: str, lone: tuple[str, ...] = (), parsed: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One row for each occurrence of an object, in the schema OCCURRENCES.

    A null payload and one that is no JSON give no rows (`unreadable` lists the latter). Records are independent, so nothing is
    shuffled; a record given twice gives its rows twice. Other columns of the input are ignored.
    """
    lone_keys, parsed_keys = frozenset(lone), frozenset(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for r, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store = Store()
                try:
                    root = stored(p, lone_keys, parsed_keys, store)
                except ValueError:
                    continue
                out += [(r, *x) for x in store.occurrences(root)]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], COLUMNS)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], COLUMNS)

    read = df.where(F.col(payload).isNotNull()).select(F.col(record).cast("long"), F.col(payload))
    return read.mapInArrow(run, OCCURRENCES)


def unreadable(df: DataFrame, record: str, payload: str) -> DataFrame:
    """(record, reason) of each payload that `flatten` gives no rows of: `no_json` for those that aren't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for r, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    loads(p)
                except ValueError:
                    bad.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64()), pa.array(["no_json"] * len(bad), pa.string())], ["record", "reason"])

    return df.where(F.col(payload).isNotNull()).select(F.col(record).cast("long"), F.col(payload)).mapInArrow(run, "record long, reason string")


def stored_objects(occurrences: DataFrame) -> DataFrame:
    """(node_hash, fields, occurrences): each distinct object once. The count combines before the shuffle."""
    return occurrences.groupBy("node_hash").agg(F.min("fields").alias("fields"), F.count("*").alias("occurrences"))


def bridge(occurrences: DataFrame) -> DataFrame:
    """(record, node_path, parent_path, list_path, ordinal, node_hash, parent_hash): where each object occurs."""
    return occurrences.select("record", "node_path", "parent_path", "list_path", "ordinal", "node_hash", "parent_hash")
