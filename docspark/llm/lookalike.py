"""One consistent form for texts that look the same but differ in characters.

A mapping from code points to their plain form is computed once: widths, ligatures and other presentation forms, spaces,
invisible characters, canonical composition and look-alike letters. These come from fixed lists for the alphabets in daily use and
from the public table of confusable characters, as the ICU library of the Spark distribution carries it, for the others. It is checked for conflicts (each key has one plain form,
and plain forms map to themselves) and compiled to one pattern over grapheme clusters, longest match first; a text is
rewritten in one pass, and text without any key is returned as it is. Case, visible accents and other digits are kept.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyspark
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts and the Latin letters that they look like.
CYRILLIC = dict(zip("АВЕКМНОРСТХІЅЈҮԌԚԜӀаеорсухіѕјһԁԛԝӏ", "ABEKMHOPCTXISJYGQWlaeopcyxisjhdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲ", "ABEZHIKMNOPTYXCjoc", strict=True))
LATIN = dict(zip("ɑɡⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "agIVXLCDMivxlcdmBPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
RADICALS = dict(zip("⺁⺂⺃⺄⺅⺆⺉⺊⺖⺘⺙⺡⺣⺦⺨⺩⺪⺬⺭⺯⺰⺱⺲⺹⺾⻁⻂⻃⻅⻆⻈⻉⻋⻌⻐⻑⻓⻔⻗⻘⻙⻚⻛⻜⻝⻠⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻳", "厂乛乚乙亻冂刂卜忄扌攵氵灬丬犭王疋示礻糹纟罓罒耂艹虎衤覀见角讠贝车辶钅長长门雨青韦页风飞食饣马骨鬼鱼鸟卤麦黄齐齿龙龟", strict=True))
HYPHENS = dict.fromkeys("‐‑﹣－", "-")
LINES = {"\x85": "\n", " ": "\n", " ": "\n", "\r": "\n"}
#: Kinds of compatibility decomposition that leave the look; superscripts, circles, fractions and fonts don't.
SAME_LOOK = {"<wide>", "<narrow>", "<small>", "<compat>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>"}
IGNORED = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFFA0}
EMOJI = r"[%s][︎️\U0001F3FB-\U0001F3FF]*(?:‍[%s][︎️\U0001F3FB-\U0001F3FF]*)+|\U0001F3F4[\U000E0020-\U000E007E]+\U000E007F"
#: Code points that may have a plain form of their own: all planes with mappings. What lies beyond are ideographs and private use.
SPACE = [*range(0x4E00), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)]


@lru_cache(maxsize=1)
def confusables() -> tuple[tuple[str, str], ...]:
    """(letter, letter a to z or A to Z) pairs of the public table of confusables that leave case and look as they are.

    The table gives each character a prototype. A letter of either case becomes the ASCII letter of its own case with the same
    prototype. The basic alphabets of Greek and Cyrillic and older Latin letters are left to the fixed lists, as the table also joins
    letters that readers tell apart (sigma and o, dotless and dotted i); so are fonts (mathematical letters) and whatever isn't a cased
    letter. Without the library's file there are none. Read on the driver; workers get the pairs with the function.
    """
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jars = sorted(glob.glob(os.path.join(home, "jars", "icu4j-*.jar")))
    if not jars:
        return ()
    with zipfile.ZipFile(jars[-1]) as jar:
        data = jar.read(next(n for n in jar.namelist() if n.endswith("/confusables.cfu")))
    body = data[struct.unpack(">H", data[:2])[0]:]
    _, _, _, keys_at, keys, values_at, values, strings_at, strings = struct.unpack(">9i", body[:36])
    text = body[strings_at : strings_at + 2 * strings].decode("utf-16-be", "surrogatepass")
    prototype = {}
    for key, value in zip(struct.unpack(f">{keys}i", body[keys_at : keys_at + 4 * keys]), struct.unpack(f">{values}H", body[values_at : values_at + 2 * values]), strict=True):
        length = (key >> 24 & 0xFF) + 1
        prototype[chr(key & 0xFFFFFF)] = chr(value) if length == 1 else text[value : value + length]
    plain_letters = defaultdict(list)
    for c in map(chr, [*range(65, 91), *range(97, 123)]):
        plain_letters[prototype.get(c, c)].append(c)
    fixed = CYRILLIC.keys() | GREEK.keys() | LATIN.keys()
    out = []
    for c, form in prototype.items():
        n, category = ord(c), unicodedata.category(c)
        basic = n < 0x250 or 0x250 <= n < 0x2B0 or 0x370 <= n < 0x400 or 0x410 <= n < 0x450 or 0x1D00 <= n < 0x2000
        twins = [x for x in plain_letters.get(form, []) if x.isupper() == (category == "Lu")]
        if category in ("Lu", "Ll") and not basic and c not in fixed and not unicodedata.decomposition(c) and len(twins) == 1:
            out.append((c, twins[0]))
    return tuple(sorted(out))


def invisible(c: str) -> bool:
    """Characters without a width of their own that leave the look of text: variation selectors, tags and format characters but
    number signs."""
    n = ord(c)
    return n in IGNORED or 0xFE00 <= n <= 0xFE0F or 0xE0000 <= n < 0xE1000 or unicodedata.category(c) == "Cf" and not (0x600 <= n <= 0x605 or n in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD))


def plain(c: str, letters: dict[str, str]) -> str:
    """The plain form of one code point; letters has the look-alikes."""
    if invisible(c):
        return ""
    if c in LINES:
        return LINES[c]
    if unicodedata.category(c) == "Zs":
        return " "
    if c in HYPHENS:
        return HYPHENS[c]
    if c in RADICALS or c in LATIN:
        return RADICALS.get(c) or LATIN[c]
    kind, _, parts = unicodedata.decomposition(c).partition(" ")
    if kind.startswith("<"):
        whole = "".join(chr(int(x, 16)) for x in parts.split())
        if kind in SAME_LOOK and not whole.startswith(" "):
            return "".join(plain(x, letters) for x in whole)
        return c
    return "".join(letters.get(x) or HYPHENS.get(x, x) for x in unicodedata.normalize("NFD", c))


class Transducer:
    """The compiled mapping; `rewrite(text)` gives the consistent form."""

    def __init__(self, letters: dict[str, str]):
        """letters: look-alikes and what they become; none keep every letter's script."""
        self.letters = letters
        space = [chr(n) for n in SPACE]
        self.table: dict[str, str] = {}
        for c in space:
            form = unicodedata.normalize("NFC", plain(c, letters))
            if form != c:
                self.table[c] = form
        for c, form in self.table.items():  # a plain form holds no key, so no order of rewriting matters
            if any(x in self.table for x in form):
                raise ValueError(f"conflict: U+{ord(c):04X} becomes {form!r}, which isn't plain")
        marks = [c for c in space if unicodedata.category(c) in ("Mn", "Mc", "Me") or invisible(c) or 0x1161 <= ord(c) <= 0x11FF]
        keys = self._ranges([*self.table])
        marks = self._ranges(marks)
        pictures = self._ranges([chr(n) for n in range(0x20000) if not 0xD800 <= n <= 0xDFFF and regex.match(r"\p{Extended_Pictographic}", chr(n))])
        emoji = EMOJI % (pictures, pictures)
        self.pattern = re.compile(f"\\r\\n|{emoji}|[^{marks}\\n][{marks}]+|[{keys}{marks}]")
        # text without marks needs no clusters: each of its characters is one
        self.marked, self.simple = re.compile(f"[{marks}\r]").search, re.compile(f"[{keys}]").sub
        self.memory: dict[str, str] = {}
        self.emoji = re.compile(emoji)

    @staticmethod
    def _ranges(chars: list[str]) -> str:
        out, codes = [], sorted(map(ord, chars))
        i = 0
        while i < len(codes):
            j = i
            while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
                j += 1
            out.append(f"\\U{codes[i]:08X}-\\U{codes[j]:08X}")
            i = j + 1
        return "".join(out)

    def _cluster(self, m: re.Match) -> str:
        key = m.group(0)
        form = self.memory.get(key)
        if form is None:
            if key == "\r\n":
                form = "\n"
            elif self.emoji.fullmatch(key):
                form = key
            else:
                form = "".join(plain(c, self.letters) for c in unicodedata.normalize("NFC", "".join(c for c in key if not invisible(c))))
                form = unicodedata.normalize("NFC", form)
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[key] = form
        return form

    def rewrite(self, text: str) -> str:
        """The consistent form of a text; rewriting it again changes nothing."""
        if text.isascii() and "\r" not in text:
            return text
        if not self.marked(text):
            return self.simple(lambda m: self.table[m.group(0)], text)
        return self.pattern.sub(self._cluster, text)


@lru_cache(maxsize=4)
def transducer(more: tuple[tuple[str, str], ...] = ()) -> Transducer:
    """The transducer to the consistent form: all look-alikes become Latin letters."""
    return Transducer({**CYRILLIC, **GREEK, **dict(more)})


class Normal:
    """The normal form of a text for reading and training: widths, spaces, invisible characters and composition as in the consistent
    form, but each word keeps its script. A word that mixes scripts takes the one script that look-alikes allow: Latin, else that of
    its other letters."""

    def __init__(self, more: tuple[tuple[str, str], ...] = ()):
        self.form, self.look = Transducer({}), transducer(more)
        self.letters = self.look.letters
        self.back = {v: k for k, v in reversed([*CYRILLIC.items()]) if v not in "SYGQW"}
        self.memory: dict[str, str] = {}

    def _word(self, m: re.Match) -> str:
        word = m.group(0)
        if word.isascii() or (form := self.memory.get(word)) is None and not any(c in self.letters for c in unicodedata.normalize("NFD", word)):
            return word
        if form is None:
            latin = lambda t: all(unicodedata.name(c, "").startswith("LATIN") for c in t if c.isalpha())
            form, looked = word, self.look.rewrite(word)
            own = [c for c in word if unicodedata.name(c, "").startswith("LATIN") and c.isalpha()]
            if own and latin(looked):
                form = looked
            elif own and all(c in self.back for c in own):
                form = "".join(self.back.get(c, c) for c in word)
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[word] = form
        return form

    def rewrite(self, text: str) -> str:
        text = self.form.rewrite(text)
        return text if text.isascii() else re.sub(r"\w+", self._word, text)


@lru_cache(maxsize=4)
def normal(more: tuple[tuple[str, str], ...] = ()) -> Normal:
    return Normal(more)


def consistent(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """`columns` with consistent, the form in which all texts that look the same are equal, and normal, the form that keeps each
    word's script (`Normal`). Null stays null, empty stays empty. Row-local."""
    more, read = confusables(), df.select(*columns, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, keep = transducer(more), normal(more)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            out = [pa.array([t and f.rewrite(t) for t in texts], pa.string()) for f in (form, keep)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*columns, "consistent", "normal"])

    return read.mapInArrow(run, ", ".join([*(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in columns), "consistent string, normal string"]))


def looks(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """`columns` with look and stored, 128-bit hashes of the consistent form and of the text itself, null for null texts."""

    more = confusables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(more)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            digest = lambda t: None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "replace"))
            stored = [digest(t) for t in texts]
            look = [s if t is None or (r := own.rewrite(t)) is t else digest(r) for t, s in zip(texts, stored, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(look, pa.binary()), pa.array(stored, pa.binary())], [*columns, "look", "stored"])

    read = df.select(*columns, text)
    schema = ", ".join([*(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in columns), "look binary, stored binary"])
    return read.mapInArrow(run, schema)


def same_look(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """(kind, id_a, id_b) of keys whose texts differ as stored but look the same; rows must have one row for each key.

    Only looks with several stored forms are joined, so copies of one text meet nothing; each pair of differing texts is part
    of the result that is asked for.
    """
    mixed = rows.groupBy(kind, "look").agg((F.min("stored") != F.max("stored")).alias("mixed")).where("mixed").select(kind, "look")
    own = rows.join(mixed, [kind, "look"], "left_semi")
    a, b = own.select(kind, "look", F.col(key).alias("id_a"), F.col("stored").alias("stored_a")), own.select(kind, "look", F.col(key).alias("id_b"), "stored")
    return a.join(b, [kind, "look"]).where("id_a < id_b and stored_a <> stored").select(kind, "id_a", "id_b")


def classes(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """(kind, key, class_id, members, links) of each key whose text looks like another text: class_id is the smallest key of its
    look, members how many keys have it, links how many of those have a text that differs as stored. Copies aren't paired."""
    forms = rows.groupBy(kind, "look", "stored").agg(F.count("*").alias("same"), F.min(key).alias("first"))
    whole = forms.groupBy(kind, "look").agg(F.sum("same").alias("members"), F.min("first").alias("class_id"), F.count("*").alias("forms")).where("forms > 1")
    links = forms.join(whole, [kind, "look"]).select(kind, "look", "stored", "class_id", "members", (F.col("members") - F.col("same")).alias("links"))
    return rows.join(links, [kind, "look", "stored"]).select(kind, key, "class_id", "members", "links")
