"""Texts that stop before the end their writer gave them.

A backward character n-gram model gives the odds that a unit ends at a position rather than goes on: its contexts are the
characters before the position, from one to ORDERS[-1] of them, under the state that the line is in there (prose, list item,
caption, a table row with or without all of its cells, open or closed code, a signature, a page line). Form is thus part of the
context and has no say of its own. Each text's final context is scored, and its log-odds are held against a threshold of its
language and kind of line, which come from the line ends of all texts. Limits of sources are learnt from all rows: lengths at
which a source has far more texts than around them. A text there may be cut anywhere, so that even odds are asked of it; other
texts are likely whole, and only what lies below almost all true ends is cut.

The model is that of all lines of all texts, but of a text's last line, which may be cut, its states alone. It is never in one place: the contexts that are asked for are found first, all texts are
counted for these, and counts and questions meet by the hash of the last three characters. A line end is scored without itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.plans.lineage import Cuts

#: Lengths of context, and the weight of the shorter context in the estimate of the longer.
ORDERS, BACKOFF, BASE = (1, 3, 6, 10), 4.0, 0.02
#: Share of the line ends of a language and kind that lie below their threshold, and how many ends a threshold needs.
QUANTILE, ENOUGH = 0.005, 500
#: How far below its threshold the last letter's score decides.
STRONG = 6.0
#: Lines of prose up to this length without the mark of an end are headings, which no text ends with: thresholds leave them out.
HEADING = 40
#: Scores are counted in steps of this size.
STEP = 0.05

ENDS = ".。!?！？…"
CLOSERS = ")]\"'»”’）】」』"
LIST = re.compile(r"\s*(?:[-•*–·]|\d{1,3}[.)])\s+")
CAPTION = re.compile(r"\s*(?:Figure|Fig\.|Table|Abbildung|Abb\.|Tabelle|Tab\.|Tableau|Figura|Tabla|Рисунок|Рис\.|Таблица|图|表)\s*[\d０-９]+")
SIGNATURE = re.compile(r"[,，]\s*\d{4}-\d{2}-\d{2}")
PAGE = re.compile(r"\s*(?:\S+\s+){0,3}\d+\s*(?:of|von|de|sur|из|/|页，共)\s*\d+\s*页?")
RULE = re.compile(r"\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$")
BAR = re.compile(r"(?<!\\)\|")
TRAIL = re.compile(r"[\W_]+$")
BREAKS = re.compile(rf"[.。!?！？…]+[{re.escape(CLOSERS)}]*(?=\s|$|[^\x00-⿿])")
#: Contexts hold one 0 for a number, and no closing quotes or brackets after the end of a sentence.
NUMBER, CLOSED = re.compile(r"\d+"), re.compile(rf"(?<=[.。!?！？…])[{re.escape(CLOSERS)}]+")
#: States of a position: prose, list item, caption, signature, page line, row that lacks cells, whole row, open code, closed code.
PROSE, ITEM, LABEL, SIGNED, PAGED, PART, ROW, OPEN, SHUT = range(1, 10)
KINDS = {PROSE: "prose", ITEM: "list", LABEL: "caption", SIGNED: "signature", PAGED: "page", PART: "table", ROW: "table", OPEN: "code", SHUT: "code"}
_F, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE, _KEY, _REST = np.uint64(pow(int(_F), -1, 1 << 64)), ~np.uint64(3), np.uint64((1 << 52) - 1)
_TAIL = 4 * ORDERS[-1]
#: Characters and contexts that are counted at a time.
CHARS, HELD = 100_000, 4_000_000


def lines(text: str) -> Iterator[tuple[str, int, int]]:
    """(line without its trailing space, state, bars that a whole row has) of each line that isn't blank; state is that of prose,
    item, label, row or code, whether open or shut."""
    every = text.split("\n")
    code, head = False, 0
    for n, line in enumerate(every):
        body = line.rstrip()
        if body.startswith("```"):
            yield body, SHUT if code else OPEN, 0
            code, head = not code, 0
        elif code and body:
            yield body, OPEN, 0
        elif body.lstrip().startswith("|"):
            if not head or n + 1 < len(every) and RULE.match(every[n + 1]):
                head = len(BAR.findall(body))
            yield body, ROW, head
        else:
            head = 0
            if body:
                yield body, ITEM if LIST.match(body) else LABEL if CAPTION.match(body) else PROSE, 0


def last_state(body: str, state: int, head: int) -> int:
    """The state at the end of a line of `lines`."""
    if state == ROW:
        return ROW if body.endswith("|") and len(body.strip()) > 1 and not body.endswith("\\|") and len(BAR.findall(body)) == head else PART
    if state == SHUT:
        return SHUT if body == "```" else OPEN
    if state == PROSE and body[-1:].isdigit() or body.endswith("页"):
        found = [m for m in SIGNATURE.finditer(body, max(0, len(body) - 16)) if m.end() == len(body)]
        if found and 2 <= len(body[: found[0].start()].strip()) <= 80:
            return SIGNED
        if len(body) < 60 and (m := PAGE.match(body)) and m.end() == len(body):
            return PAGED
    return state


def states(body: str, state: int, head: int) -> np.ndarray:
    """The state at each position 1..len(body) of a line of `lines`."""
    out = np.full(len(body), _inside(state), np.uint8)
    for at, other in special(body, state, head):
        out[at] = other
    return out


def _inside(state: int) -> int:
    return OPEN if state == SHUT else PART if state == ROW else state


def special(body: str, state: int, head: int) -> Iterator[tuple[int, int]]:
    """(place, state) of the characters of a line of `lines` whose state isn't that of the characters around them."""
    if state == ROW:
        ends = [m.end() for m in BAR.finditer(body)]
        if 0 < head <= len(ends) and (head > 1 or len(body.strip()) > 1):
            yield ends[head - 1] - 1, ROW
    elif state == SHUT:
        if body == "```":
            yield len(body) - 1, SHUT
    elif state == PROSE:
        for m in SIGNATURE.finditer(body):
            if 2 <= len(body[: m.start()].strip()) <= 80:
                yield m.end() - 1, SIGNED
        if (m := PAGE.match(body)) and m.end() < 60:
            yield m.end() - 1, PAGED


def canonical(body: str) -> str:
    return NUMBER.sub("0", CLOSED.sub("", body))


def training(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of contexts, ends, stops) of the positions of each line, hashes as rows from short to long; `counted` says the same of
    many lines at once.

    A position ends a unit at the end of a line or sentence; it stops one if only marks lie between it and such an end. Of the last
    line, which may be cut, the states alone count (one row of hashes).
    """
    every = list(lines(text))
    for n, (body, kind, head) in enumerate(every):
        state, ends = states(body, kind, head), np.zeros(len(body), bool)
        ends[-1] = kind not in (OPEN, SHUT) or state[-1] == SHUT
        if kind in (PROSE, ITEM, LABEL):
            ends[[m.end() - 1 for m in BREAKS.finditer(body)]] = True
        stops = ends.copy()
        for m in re.finditer(r"(?<=[^\W_])[\W_]+", body):
            stops[m.start() - 1] |= ends[m.start() : m.end()].any()
        keep = np.array([not c.isspace() for c in body])
        for m in CLOSED.finditer(body):  # what is dropped from contexts hands its state and end to the mark before it
            state[m.start() - 1] = state[m.end() - 1]
            ends[m.start() - 1] |= ends[m.end() - 1]
            keep[m.start() : m.end()] = False
        for m in NUMBER.finditer(body):
            keep[m.start() : m.end() - 1] = False
        dropped = np.zeros(len(body), bool)
        for p in (CLOSED, NUMBER):
            for m in p.finditer(body):
                dropped[m.start() : m.end() - (p is NUMBER)] = True
        place = np.cumsum(~dropped) - 1  # where a position is in the canonical line
        codes = np.frombuffer(("\n" + canonical(body)).encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in np.array_split(np.flatnonzero(keep), 1 + len(body) // 50_000):
            if n == len(every) - 1:
                yield hashes(codes[:0], at, state[at])[:1], ends[at], stops[at]
            else:
                yield hashes(codes, place[at] + 1, state[at]), ends[at], stops[at]


def hashes(codes: np.ndarray, at: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rows of hashes of the contexts that end with codes[at] (none before the first code), for each order from 0."""
    with np.errstate(over="ignore"):
        sums, h, factor = [], np.zeros(len(at), np.uint64), np.uint64(1)
        for back in range(ORDERS[-1] if len(codes) else 0):
            i = at - back
            h = h + np.where(i >= 0, _value(codes[np.maximum(i, 0)]) * factor, np.uint64(0))
            factor = factor * _F
            if back + 1 in ORDERS:
                sums.append(h)
        return keyed(state, sums)


def _value(codes: np.ndarray) -> np.ndarray:
    """What a code counts for in a hash; nothing for the padding before a short line."""
    return np.where(codes > 0, codes.astype(np.uint64) + np.uint64(31), np.uint64(0))


def _under(state: np.ndarray) -> np.ndarray:
    return (state.astype(np.uint64) + np.uint64(7)) * _S


def _mixed(h: np.ndarray, k: int, under: np.ndarray, top: np.ndarray | None) -> np.ndarray:
    """A hash of order k without its last two bits, which begins with the first bits of `top`."""
    out = (((h ^ (h >> np.uint64(29))) * _F + np.uint64(k - 1)) ^ under) & _KEY
    return out if top is None else (out & _REST) | (top & ~_REST)


def keyed(state: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
    """Rows of hashes for order 0 and the orders of `sums` (of codes, by ORDERS). Longer contexts begin with the bits of their last
    ORDERS[1] characters, so that they meet in one part."""
    with np.errstate(over="ignore"):
        out = [(under := _under(state)) & _KEY]
        for k, h in zip(ORDERS, sums, strict=False):
            out.append(_mixed(h, k, under, out[2] if k > ORDERS[1] else None))
    return np.stack(out)


def context(body: str) -> str:
    """The last characters of a line in canonical form, with padding before a short one."""
    text = canonical(body[-_TAIL:])
    return (text if len(body) > _TAIL else "\n" + text)[-ORDERS[-1] :].rjust(ORDERS[-1], "\0")


def ended(contexts: list[str], state: list[int]) -> np.ndarray:
    """`hashes` of many contexts at once."""
    codes = np.frombuffer("".join(contexts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return hashes(codes, (np.arange(len(contexts)) + 1) * ORDERS[-1] - 1, np.array(state, np.uint8))


def tails(bodies: list[str], state: list[int]) -> np.ndarray:
    """`hashes` of the ends of many lines at once."""
    return ended([context(b) for b in bodies], state)


class Model:
    """Counts (n, ends, stops) by hash of context; `log_odds` interpolates from short contexts to long."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, ends: np.ndarray, stops: np.ndarray):
        self.keys, self.n, self.counts = keys, n, {"ends": ends, "stops": stops}

    def log_odds(self, contexts: np.ndarray, what: str = "ends") -> np.ndarray:
        """The log-odds that a unit ends (stops) after contexts (`hashes`) rather than goes on."""
        p = np.full(contexts.shape[1], BASE)
        if not len(self.keys):
            return np.log(p / (1 - p))
        for row in contexts:
            i = np.minimum(np.searchsorted(self.keys, row), len(self.keys) - 1)
            hit = self.keys[i] == row
            p = (np.where(hit, self.counts[what][i], 0) + BACKOFF * p) / (np.where(hit, self.n[i], 0) + BACKOFF)
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return np.log(p / (1 - p))


@cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a code is a letter or digit, a space, a decimal digit."""
    every = "".join(map(chr, range(0x110000)))
    out = []
    for p in (r"[^\W_]+", r"\s+", r"\d+"):
        table = np.zeros(len(every), bool)
        for m in re.finditer(p, every):
            table[m.start() : m.end()] = True
        out.append(table)
    return tuple(out)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of _F and of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHARS + 2 * ORDERS[-1], x)]), dtype=np.uint64) for x in (_F, _INVERSE))


def positions(some: list[tuple[str, int, int, bool]]) -> tuple[np.ndarray, ...]:
    """(codes, state, ends, stops, keep, last) of the canonical lines of `some`, (line, state, bars, whether it is a text's last), one
    after the other with padding between them. keep: a position that counts; last: it is in a last line. See `training`."""
    word, space, digit = _classes()
    sizes = np.array([len(x[0]) for x in some])
    pad = ORDERS[-1] - 2  # before the line break that a context may begin with
    big = "".join(f"{'\0' * pad}\n{x[0]}\n" for x in some)
    codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.cumsum(sizes + pad + 2) - 1  # where each line has ended
    state = np.repeat(np.array([_inside(x[1]) for x in some], np.uint8), sizes + pad + 2)
    last = np.repeat(np.array([x[3] for x in some], bool), sizes + pad + 2)
    inside = np.repeat(np.tile([False, True, False], len(some)), np.column_stack([np.full(len(some), pad + 1), sizes, np.ones(len(some), int)]).ravel())
    ends = np.zeros(len(codes), bool)
    found = np.array([m.end() - 1 for m in BREAKS.finditer(big)], int)
    ends[found[inside[found] & (state[found] <= LABEL)]] = True
    for (body, kind, head, _), at in zip(some, (stop - sizes).tolist(), strict=True):
        if kind in (ROW, SHUT, PROSE):
            for i, other in special(body, kind, head):
                state[at + i] = other
    kinds = np.array([x[1] for x in some])
    ends[stop - 1] = ((kinds != OPEN) & (kinds != SHUT)) | (state[stop - 1] == SHUT)
    # the marks after a letter up to the next letter or the end of the line
    edge = np.flatnonzero(word[codes] | ~inside)
    upto = np.concatenate([[0], np.cumsum(ends)])
    stops = ends.copy()
    here, after = edge[:-1], edge[1:]
    stops[here[inside[here] & (upto[after] - upto[here + 1] > 0)]] = True
    keep, dropped = inside & ~space[codes], np.zeros(len(codes), bool)
    for m in CLOSED.finditer(big):  # what is dropped from contexts hands its state and end to the mark before it
        state[m.start() - 1] = state[m.end() - 1]
        ends[m.start() - 1] |= ends[m.end() - 1]
        dropped[m.start() : m.end()] = True
    digits = digit[codes]
    dropped[:-1] |= digits[:-1] & digits[1:]
    stay = ~dropped
    return np.where(digits, np.uint32(48), codes)[stay], state[stay], ends[stay], stops[stay], keep[stay], last[stay]


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, n, ends, stops) of keys (a hash with end and stop as its last bits) that occur n times (once), each hash once."""
    if not len(keys):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if n is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[first], np.diff(np.append(first, len(keys)))
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    h = keys & _KEY
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first), np.add.reduceat(n * ((keys >> np.uint64(1)) & np.uint64(1)).astype(np.int64), first), np.add.reduceat(n * (keys & np.uint64(1)).astype(np.int64), first)


def counted(texts: Iterator[str], asked: np.ndarray | None = None) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(low, hash, n, ends, stops) of contexts of some texts; low: of the orders 0 and 1, which come whole. A hash may come more than once.

    asked: bits of the contexts that count, by `slots`; none of them is left out, others may be in. Of those longer than a context that
    isn't asked for none is asked for.
    """
    low: list[np.ndarray] = []
    low_n: list[np.ndarray] = []
    held: list[np.ndarray] = []
    size = 0

    def take(some: list[tuple[str, int, int, bool]]) -> None:
        nonlocal size
        codes, state, ends, stops, keep, last = positions(some)
        marks = ends.astype(np.uint8) << 1 | stops
        plain = np.bincount(state[keep].astype(int) << 2 | marks[keep], minlength=64)
        for at in np.flatnonzero(plain).tolist():
            low.append(keyed(np.array([at >> 2], np.uint8), [])[0] | np.uint64(at & 3))
            low_n.append(plain[at : at + 1])
        keep = keep & ~last
        ones = np.sort((state[keep].astype(np.int32) << 23 | codes[keep].astype(np.int32) << 2) | marks[keep])
        first = np.flatnonzero(np.concatenate([[True], ones[1:] != ones[:-1]])) if len(ones) else np.zeros(0, int)
        low_n.append(np.diff(np.append(first, len(ones))))
        ones = ones[first]
        low.append(keyed(ones >> 23, [_value((ones >> 2) & 0x1FFFFF)])[1] | (ones & 3).astype(np.uint64))
        power, inverse = _powers()
        for a in range(0, len(codes), CHARS):
            start = max(0, a - ORDERS[-1])  # contexts reach back
            part = slice(start, a + CHARS)
            with np.errstate(over="ignore"):
                values = _value(codes[part])
                upto = np.concatenate([[np.uint64(0)], np.cumsum(values * inverse[: len(values)], dtype=np.uint64)])
                at = np.flatnonzero(keep[a : a + CHARS]) + (a - start)
                under, top = _under(np.arange(16, dtype=np.uint8))[state[part][at]], None
                for k in ORDERS[1:]:
                    h = _mixed((upto[at + 1] - upto[np.maximum(at + 1 - k, 0)]) * power[at], k, under, top)
                    top = h if top is None else top
                    if asked is not None:
                        slot = slots(h, asked)
                        hit = np.flatnonzero((asked[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                        at, h, under, top = at[hit], h[hit], under[hit], top[hit]
                    held.append(h | marks[part][at])
                    size += len(h)

    def out(least: int) -> Iterator:
        nonlocal size
        if size > least:
            yield False, *summed(np.concatenate(held))
            held.clear()
            size = 0
        if low and (least == 0 or len(low) > 4000):
            yield True, *summed(np.concatenate(low), np.concatenate(low_n))
            low.clear()
            low_n.clear()

    some, chars = [], 0
    for t in texts:
        every = list(lines(t))
        some += [(*x, n == len(every) - 1) for n, x in enumerate(every)]
        chars += len(t)
        if chars >= CHARS:
            take(some)
            some, chars = [], 0
            yield from out(HELD)
    if some:
        take(some)
    yield from out(0)


def slots(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) & np.uint64(8 * len(bits) - 1)).astype(np.int64)


def tagged(lang: str) -> F.Column:
    """The two letters a to z that a language tag begins with, in lower case; "" where it doesn't. So there are 677 at most."""
    return F.lower(F.regexp_extract(F.trim(F.coalesce(lang, F.lit(""))), "^[A-Za-z]{2}", 0))


def counts(texts: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """(low, h, n, ends, stops): the counts of `counted` over all rows of `texts` (text). Sums, so that they don't depend on how rows are
    laid out in files or tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low, h, *rest in counted((t for b in batches for t in b.column(0).to_pylist()), asked):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), low)), pa.array(h.view(np.int64)), *map(pa.array, rest)], ["low", "h", "n", "ends", "stops"])

    rows = texts.where(F.length(F.trim("text")) > 0).mapInArrow(count, "low boolean, h long, n long, ends long, stops long")
    return rows.groupBy("low", "h").agg(*[F.sum(c).alias(c) for c in ("n", "ends", "stops")])


def _model(table: pa.Table) -> Model:
    keys = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Model(keys[order], *(table.column(c).to_numpy()[order] for c in ("n", "ends", "stops")))


def fit(df: DataFrame, key: str, text: str, lang: str, sample: int | None = None) -> Model:
    """The model of all texts, or of about `sample` of each language drawn by hashed id, on the driver: for a caller who wants it in hand.
    The queries have theirs from `scored`."""
    own = df.where(F.length(F.trim(text)) > 0).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), tagged(lang).alias("tag"))
    if sample is not None:
        many = own.groupBy("tag").agg(F.count("*").alias("many"))  # at most 677 rows
        own = own.join(F.broadcast(many), "tag").where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(1_000_000) * sample / F.col("many"))
    return _model(counts(own.select("text")).toArrow())


#: One row for each text (key is set) or count of scores at line ends (n is set).
FINAL = "key long, tag string, kind string, suffix string, ends double, letter double, stops double, chars long, bytes long, print long, source string, what string, step int, n long"
_NAMES = [x.split()[0] for x in FINAL.split(", ")]
SPOKEN = ("prose", "list", "caption")

#: A row for each text (what is `text`: its whole final context and, as l0 to l10, that before the marks at its end), and for each
#: context of other line ends how often it comes (`ends`: the whole one, `stops`: that before the marks).
_H = [f"h{k}" for k in (0, *ORDERS)]
_L = [f"l{k}" for k in (0, *ORDERS)]
CONTEXTS = "key long, tag string, kind string, suffix string, chars long, bytes long, print long, source string, what string, n long, " + ", ".join(f"{c} long" for c in _H + _L)
_CONTEXTS = [x.split()[0] for x in CONTEXTS.split(", ")]


def contexts(df: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """Rows (CONTEXTS) of the final context of each text that isn't blank and of its other lines' ends, by language and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, state, lone = [], [], [], {}
            for k, t, tag, origin in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                every = list(lines(t))
                if not every:
                    continue
                body, kind, head = every[-1]
                suffix = m.group(0) if (m := TRAIL.search(body)) else ""
                end = last_state(body, kind, head)
                last += [context(body), context(body[: len(body) - len(suffix)] or body)]
                state += [end, end if not suffix else kind if kind in (PROSE, ITEM, LABEL) else PART if kind == ROW else OPEN]
                rows.append((k, tag, KINDS[end], suffix, len(t), len(raw := t.encode("utf-8", "replace")), xxhash.xxh3_64_intdigest(raw) >> 1, origin, "text", 1))
                for b, kind, head in every[:-1]:
                    if kind in (ITEM, LABEL) or kind == PROSE and (len(b) > HEADING or b[-1] in ENDS):
                        end = last_state(b, kind, head)
                        letter = b[: len(b) - len(m.group(0))] or b if (m := TRAIL.search(b)) else b
                        for what, x, at in (("ends", b, end), ("stops", letter, kind)):
                            one = tag, KINDS[at], what, at, context(x)
                            lone[one] = lone.get(one, 0) + 1
            if not rows:
                continue
            h = ended(last + [x[4] for x in lone], state + [x[3] for x in lone])
            of = [h[:, 0 : 2 * len(rows) : 2], h[:, 1 : 2 * len(rows) : 2], h[:, 2 * len(rows) :]]
            first = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=False)]
            yield pa.RecordBatch.from_arrays([*first, *[pa.array(np.ascontiguousarray(r).view(np.int64)) for r in (*of[0], *of[1])]], _CONTEXTS)
            if lone:
                none = [(None, x[0], x[1], None, None, None, None, None, x[2], n) for x, n in lone.items()]
                first = [pa.array(c, f.type) for c, f in zip(zip(*none, strict=True), _SCHEMA, strict=False)]
                yield pa.RecordBatch.from_arrays([*first, *[pa.array(np.ascontiguousarray(r).view(np.int64)) for r in of[2]], *[pa.nulls(len(none), pa.int64())] * len(_L)], _CONTEXTS)

    own = df.where(F.length(F.trim(text)) > 0).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), tagged(lang).alias("tag"), F.coalesce(source, F.lit("")).alias("source"))
    return own.mapInArrow(run, CONTEXTS)


_SCHEMA = pa.schema([(x.split()[0], pa.int64() if x.endswith(" long") else pa.string()) for x in CONTEXTS.split(", ")])
_SCORES = "h long, tag string, kind string, what string, ends double, stops double, step int, n long"
_SCORED = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}[x.split()[1]]) for x in _SCORES.split(", ")])


def _scores(asked: pa.Table, ends: np.ndarray, stops: np.ndarray) -> pa.Table:
    """Rows (_SCORES) of questions (tag, kind, what, n and hashes) with these log-odds: of contexts of texts by their longest hash, of line
    ends counted by STEP."""
    what = np.array(asked.column("what").to_pylist(), object)
    text = what == "text"
    out = {"h": asked.column(_H[-1]).filter(pa.array(text)), "what": pa.array(what[text], pa.string()), "ends": pa.array(ends[text]), "stops": pa.array(stops[text])}
    score = np.where(what == "ends", ends, stops)[~text]
    lone = asked.select(["tag", "kind", "what", "n"]).filter(pa.array(~text)).append_column("step", pa.array(np.floor(score / STEP).astype(np.int32)))
    lone = lone.group_by(["tag", "kind", "what", "step"]).aggregate([("n", "sum")]).rename_columns(["tag", "kind", "what", "step", "n"])
    full = lambda found, n: pa.table([found[f.name] if f.name in found else pa.nulls(n, f.type) for f in _SCORED], _SCORED.names).cast(_SCORED)
    return pa.concat_tables([full(out, int(text.sum())), full({c: lone.column(c) for c in lone.column_names}, len(lone))])


def _asked(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in _H])


def _questions(rows: DataFrame) -> DataFrame:
    """(tag, kind, what, n, h0 to h10): each context of rows (CONTEXTS) that is asked for, those of texts once however many have them."""
    lone = rows.where("what <> 'text'").groupBy("tag", "kind", "what", *_H).agg(F.sum("n").alias("n"))
    both = F.explode(F.array(*[F.struct(*[F.col(c).alias(h) for c, h in zip(cs, _H, strict=True)]) for cs in (_H, _L)])).alias("x")
    text = rows.where("what = 'text'").select(both).select("x.*").distinct().withColumn("what", F.lit("text"))
    return lone.unionByName(text, allowMissingColumns=True)


def scored_by(rows: DataFrame, model: Model, cuts: Cuts) -> DataFrame:
    """Rows (FINAL) of rows (CONTEXTS) with the log-odds that a model gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _asked(asked := pa.Table.from_batches([b]))
            yield from _scores(asked, model.log_odds(h), model.log_odds(h, "stops")).to_batches()

    return _final(rows, cuts.cut(_questions(rows).mapInArrow(run, _SCORES)))


def scored(rows: DataFrame, texts: DataFrame, cuts: Cuts) -> DataFrame:
    """Rows (FINAL) of rows (CONTEXTS) with the log-odds that the model of all texts gives.

    Of the texts only contexts are counted that rows ask for, told by a map of bits of bounded size. Counts of the orders 0 and 1 (a state
    and a letter) are in every task; longer ones meet their questions in parts by the hash of their last three characters. A line
    end's own position is taken off the counts that score it, so that its text has no more say than another.
    """
    long = F.explode(F.array(*_H[2:], *_L[2:])).alias("h")
    ask = rows.select(long).where("h is not null")
    size = 1 << min(28, max(15, math.ceil(math.log2(16 * (1 + ask.agg(F.approx_count_distinct("h")).first()[0])))))
    slot = F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(size - 1)) + 1
    bits = np.zeros(size // 8, np.uint8)
    for r in ask.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect():  # 32 MB at most
        bits[(r.at - 1) * 4096 : r.at * 4096] = np.frombuffer(r.bits, np.uint8)
    known = cuts.cut(counts(texts, bits))
    short = _model(known.where("low").select("h", "n", "ends", "stops").toArrow())  # as many as states and letters
    asked = cuts.cut(_questions(rows))
    parts = 1 << min(12, max(4, math.ceil(math.log2(1 + (asked.count() + known.count()) / 100_000))))

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        h, model = _asked(asked), _model(found)
        own = np.array([x != "text" for x in asked.column("what").to_pylist()], np.int64)
        p = {what: np.full(len(own), BASE) for what in ("ends", "stops")}
        for k, row in enumerate(h):
            m = short if k < 2 else model
            i = np.minimum(np.searchsorted(m.keys, row), max(len(m.keys) - 1, 0))
            hit = (m.keys[i] == row).astype(np.int64) if len(m.keys) else np.zeros(len(row), np.int64)
            count = lambda c: np.maximum(np.where(hit, c[i], 0) - own, 0) if len(c) else np.zeros(len(row), np.int64)  # noqa: B023, E731
            n = count(m.n)
            p = {what: (np.minimum(count(m.counts[what]), n) + BACKOFF * p[what]) / (n + BACKOFF) for what in p}
        odds = {what: np.log((x := np.clip(p[what], 1e-12, 1 - 1e-12)) / (1 - x)) for what in p}
        return _scores(asked, odds["ends"], odds["stops"])

    part = lambda h: F.shiftrightunsigned(h, 52).bitwiseAND(F.lit(parts - 1)).cast("int").alias("part")
    asked = asked.select(part(_H[2]), "tag", "kind", "what", "n", *_H)
    found = known.where("not low").select(part("h"), "h", "n", "ends", "stops")
    return _final(rows, cuts.cut(asked.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, _SCORES)))


def _final(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows (FINAL) of rows (CONTEXTS) and their scores. ends: log-odds that a unit ends after the final context; letter: the same before
    the marks that end the text (`suffix`); stops: that a unit stops there. Line ends are counted by language, kind and STEP."""
    of = scores.where("what = 'text'")
    whole, before = of.select(F.col("h").alias(_H[-1]), "ends"), of.select(F.col("h").alias(_L[-1]), F.col("ends").alias("letter"), "stops")
    texts = rows.where("what = 'text'").drop("what", "n").join(whole, _H[-1]).join(before, _L[-1])
    return texts.drop(*_H, *_L).unionByName(scores.where("what <> 'text'").select("tag", "kind", "what", "step", "n"), allowMissingColumns=True).select(*_NAMES)


def thresholds(rows: DataFrame) -> DataFrame:
    """(tag, kind, low_ends, low_stops) from the counts in `rows` (FINAL), exact to STEP; the tag * stands for all languages.

    A threshold is the score below which QUANTILE of the line ends lie; null where there are fewer than ENOUGH.
    """
    counts = rows.where("n is not null").select(F.explode(F.array("tag", F.lit("*"))).alias("tag"), "kind", "what", "step", "n").groupBy("tag", "kind", "what", "step").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("tag", "kind", "what")  # of at most as many rows as scores have steps
    ranked = counts.select("*", F.sum("n").over(own.orderBy("step")).alias("upto"), F.sum("n").over(own).alias("all"))
    low = ranked.where((F.col("upto") >= F.col("all") * QUANTILE) & (F.col("all") >= ENOUGH)).groupBy("tag", "kind", "what").agg((F.min("step") * STEP).alias("low"))
    return low.groupBy("tag", "kind").agg(*[F.max(F.when(F.col("what") == w, F.col("low"))).alias(f"low_{w}") for w in ("ends", "stops")])


def limits(rows: DataFrame) -> DataFrame:
    """(source, unit, size, n, sign): lengths at which a source cuts, from rows (source, chars, bytes, suffix, print) of all texts.

    A limit holds at least 4 different texts and 8 times as many as the lengths within a tenth of it do on average. Byte limits count
    a cut that leaves up to 3 bytes free. sign: the suffix of at least half of the texts there, if no
    letter ends them.
    """
    both = rows.select("source", "suffix", "print", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x")).select("source", "suffix", "print", "x.unit", "x.size").groupBy("source", "unit", "size", "print").agg(F.min("suffix").alias("suffix"))
    at = both.groupBy("source", "unit", "size").agg(F.count("*").alias("n"), F.mode("suffix", True).alias("sign"), F.count_if(F.col("suffix") != "").alias("signed"))
    # the same ranges of a tenth for all, so that their sums need no window over a source
    step = F.floor(F.log(F.greatest(F.col("size"), F.lit(2)).cast("double")) / F.log(F.lit(1.1)))
    around = at.groupBy("source", "unit", step.alias("range")).agg(F.sum("n").alias("total"))
    near = at.withColumn("range", step).where("n >= 4").join(around, ["source", "unit", "range"])
    usual = (F.col("total") - F.col("n")) / F.greatest(F.pow(F.lit(1.1), F.col("range")) * 0.1, F.lit(1.0))
    peaks = near.withColumn("usual", usual).where("usual * 8 + 2 < n")
    sign = F.when((F.col("signed") * 2 >= F.col("n")) & ~F.trim("sign").isin(".", "。", "") & ~F.col("sign").rlike("[|`\\n)]"), F.col("sign"))
    return peaks.select("source", "unit", "size", "n", sign.alias("sign"))


def truncated(df: DataFrame, key: str, text: str, lang: str, source: str, model: Model | None = None) -> DataFrame:
    """(key, source, cut) for each row with a text; null, empty and blank texts are not cut. See `judge`.

    A missing source counts as one of its own. A model of the caller's own may be given instead of that of all texts.
    """
    cuts = Cuts(df.sparkSession)
    rows = cuts.cut(contexts(df, key, text, lang, source))  # narrow rows, read several times
    scores = scored_by(rows, model, cuts) if model else scored(rows, df.select(F.col(text).alias("text")), cuts)
    return judge(cuts.cut(scores)).select(F.col("key").alias(key), F.col("source").alias(source), "cut")


def judge(rows: DataFrame) -> DataFrame:
    """The texts of `rows` (FINAL) with the column `cut`.

    The log-odds of the final context decide: against even odds at a limit of the source, else against the threshold of language
    and kind, which is at most even odds; in prose, items and captions those of the last letter too, against STRONG below theirs. What a source puts after its cuts, and a replaced byte, are no part of the text: what is before them is scored. A text
    that ends in a replaced byte is cut in any case.
    """
    texts = rows.where("n is null").drop("what", "step", "n")
    peaks = limits(texts)
    by_chars = peaks.where("unit = 'chars'").select("source", F.col("size").alias("chars"), F.lit(True).alias("at_chars"), F.col("sign").alias("sign1"))
    spread = F.explode(F.sequence(F.col("size") - 3, F.col("size") + 3))
    by_bytes = peaks.where("unit = 'bytes' and sign is null").select("source", spread.alias("bytes"), F.lit(True).alias("at_bytes")).distinct()
    low = thresholds(rows)
    pooled = low.where("tag = '*'").select("kind", F.col("low_ends").alias("all_ends"), F.col("low_stops").alias("all_stops"))
    out = texts.join(by_chars, ["source", "chars"], "left").join(by_bytes, ["source", "bytes"], "left").join(low.where("tag <> '*'"), ["tag", "kind"], "left").join(pooled, "kind", "left")
    at_limit = F.col("at_chars").isNotNull() | F.col("at_bytes").isNotNull()
    replaced = F.col("suffix").endswith("\ufffd")
    signed = F.coalesce(F.col("suffix").endswith(F.trim("sign1")), F.lit(False))
    end = F.when(replaced | signed, F.col("letter")).otherwise(F.col("ends"))
    short = end < F.when(at_limit | signed, 0.0).otherwise(F.least(F.lit(0.0), F.coalesce("low_ends", "all_ends", F.lit(0.0))))
    stop = F.col("kind").isin(*SPOKEN) & (F.col("stops") < F.coalesce("low_stops", "all_stops") - STRONG)
    return out.withColumn("cut", short | F.coalesce(stop, F.lit(False)) | replaced)
