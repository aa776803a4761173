import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import lookalike, markup, packing, splitting, tokenizer, truncation
from docspark.plans.lineage import Cuts

VOCABULARY = f"{tokenizer.FOLDER}/{tokenizer.VOCABULARY}"
ODD = ["", " ", "  ", "\n", "a  b\t \n c", "　x", "a ", " a", "don't  \r\n it's", "é́ 🙂🙂 x²½ \u200d", "<|endoftext|> x", "a" * 300, "中文。没有空格，很长", "\x00\x1f", "x\n y\n\nz \n", "a\u00a0b c"]

# tokenizer


@pytest.fixture(scope="module")
def bpe():
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary")
    return tokenizer.load(VOCABULARY)


def test_perfect_hash():
    keys = [f"k{n}".encode() for n in range(2000)]
    h = tokenizer.PerfectHash(keys)
    assert sorted(h.get(k) for k in keys) == list(range(2000)) and h.get(b"other") is None
    again = tokenizer.PerfectHash(keys, h.shift)
    assert [again.get(k) for k in keys] == [h.get(k) for k in keys]
    assert tokenizer.PerfectHash([]).get(b"x") is None and tokenizer.PerfectHash([b"x"]).get(b"x") == 0


def test_merges_against_brute_force(bpe):
    ranks = {k: i for k, i in zip(bpe.hash.keys, bpe.ids, strict=True)}

    def slow(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    rnd = random.Random(2)
    for _ in range(300):
        data = bytes(rnd.choice(b"abcdehilnorst 0123aaa\xc3\xa9") for _ in range(rnd.randrange(1, 40)))
        assert bpe.merge(data) == slow(data)


def test_ids_equal_the_public_library(bpe):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(f"{tokenizer.FOLDER}/byte_bpe_50k.json")
    theirs.encode_special_tokens = True
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice("ab' \n\t.,é中1²_-\u00a0") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert bpe.encode(t) == theirs.encode(t, add_special_tokens=False).ids, repr(t)
        assert bpe.count(t) == len(bpe.encode(t))


def test_encode_rows(spark, bpe):
    rows = [(1, "a b", "x"), (2, None, None), (3, "", "y"), (1, "a b", "x"), (None, "c", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in tokenizer.encode(df, "doc_id", "text").collect())
    assert got == [(0, bpe.encode("c")), (1, bpe.encode("a b")), (1, bpe.encode("a b")), (2, []), (3, [])]
    assert sorted(r.n_tokens for r in tokenizer.count_tokens(df, "doc_id", "text").collect()) == [0, 0, 1, 2, 2]
    assert tokenizer.encode(df.limit(0), "doc_id", "text").count() == 0


# packing


def test_knapsack_against_brute_force():
    rnd = random.Random(5)
    for _ in range(40):
        sizes = np.array(rnd.sample(range(1, 12), 4))
        values = np.array([rnd.random() for _ in range(4)])
        counts = packing.best_filling(sizes, values, 17)
        assert (counts * sizes).sum() <= 17
        best = max(sum(c * v for c, v in zip(x, values, strict=True)) for x in itertools.product(range(18), repeat=4) if sum(c * s for c, s in zip(x, sizes, strict=True)) <= 17) if _ < 4 else (counts * values).sum()
        assert abs((counts * values).sum() - best) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_item_once(seed):
    rnd = np.random.default_rng(seed)
    sizes = np.sort(rnd.choice(np.arange(1, 101), 40, replace=False))
    demand = rnd.integers(1, 500, 40)
    out = packing.plan(sizes, demand, 100, 1000)
    assert all((f * sizes).sum() <= 100 for f, _ in out)
    assert (sum(f * n for f, n in out) == demand).all()
    rooms, bins = {}, 0  # best fit decreasing, item by item
    for s in sorted(np.repeat(sizes, demand).tolist(), reverse=True):
        room = min((r for r, n in rooms.items() if r >= s and n), default=None)
        if room is None:
            bins, room = bins + 1, 100
        else:
            rooms[room] -= 1
        rooms[room - s] = rooms.get(room - s, 0) + 1
    assert sum(n for _, n in out) <= bins * 1.002 + 2
    assert packing.plan(np.array([], int), np.array([], int), 100) == []


def test_pack_rows(spark):
    rnd = random.Random(1)
    rows = [(n, rnd.choice([0, None, 1, 7, 30, 30, 30, 64, 65, 64 * 3 + 5, rnd.randrange(64)]), "c") for n in range(600)]
    df = spark.createDataFrame(rows, "id long, size int, container string")
    got = packing.pack(df, "id", "size", 64, rounds=50).collect()
    room = {}
    for r in got:
        room[r.container] = room.get(r.container, 0) + r.n
    assert max(room.values()) <= 64
    for n, size, _ in rows:
        own = sorted((r.piece, r.first, r.n) for r in got if r.id == n)
        size = size or 0
        assert sum(x[2] for x in own) == size and len(own) == max(1, -(-size // 64)) and [x[1] for x in own] == [64 * i for i in range(len(own))]
    assert len(room) <= -(-sum(r[1] or 0 for r in rows) // 64) * 1.03 + 2
    assert packing.pack(df.limit(0), "id", "size", 64).count() == 0
    assert {r.container for r in packing.pack(df.where("coalesce(size, 0) = 0"), "id", "size", 64).collect()} == {0}
    with pytest.raises(ValueError):
        packing.pack(df, "id", "size", 0)


# splitting


def pieces_ok(text, limit, overlap):
    got = splitting.split(text, limit, overlap)
    shared = overlap
    assert got[0][0] == 0 and got[-1][1] == len(text) and got[-1][2] == "end"
    for (a, b, _), (c, d, _) in itertools.pairwise(got):
        assert b - c == shared and d > b and a < c
    assert all(0 < b - a <= limit for a, b, _ in got)
    return got


def test_splits_cover_the_text():
    rnd = random.Random(3)
    words = ["word", "sentence.", "end!\n", "中文。", "a, b", "é", "👩🏽‍🔧", "x" * 60, "\n\n"]
    for _ in range(150):
        text = "".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 150)))
        limit = rnd.randrange(20, 200)
        pieces_ok(text, limit, rnd.choice([0, 2, 9, limit // 2, limit * 5 // 8, limit - 1]))
    pieces_ok("the tide " * 30, 40, 25)
    for limit, overlap in ((10, 10), (10, -1), (0, 0)):
        with pytest.raises(ValueError):
            splitting.split("x" * 30, limit, overlap)
    assert splitting.split(None, 10, 1) == splitting.split("", 10, 1) == [] and splitting.split("short", 10, 1) == [(0, 5, "end")]
    pieces_ok("x" * 1000, 3, 1), pieces_ok("x" * 50, 1, 0)


def test_cuts_are_natural_where_possible():
    text = " ".join(f"This is sentence number {n} of the text." for n in range(60))
    assert all(text[:e].endswith(".") and k == "sentence" for _, e, k in pieces_ok(text, 200, 20)[:-1])
    assert all(k == "word" for _, _, k in pieces_ok("word " * 200, 50, 5)[:-1])
    assert all(k == "forced" for _, _, k in pieces_ok("x" * 300, 50, 5)[:-1])
    emoji = "👩🏽‍🔧" * 60
    assert all(not splitting.joins(emoji, e) for _, e, _ in pieces_ok(emoji, 50, 0))


def test_edits_stay_local():
    rnd = random.Random(8)
    text = " ".join(f"{rnd.choice('abcdef') * rnd.randrange(2, 9)} {rnd.random():.6f}." for _ in range(600))
    cuts = lambda t: {t[max(0, e - 40) : e] for _, e, _ in splitting.split(t, 300, 30)}
    edited = text[:200] + "INSERTED WORDS. " + text[200:]
    assert len(cuts(text) & cuts(edited)) >= 0.8 * len(cuts(text))


def test_split_rows_and_spans(spark):
    spans = "array<struct<element_id:string,start:int,end:int>>"
    rows = [("a", "one two three. " * 10, 50, 5, [("e1", 3, 78), ("e2", 0, 74)]), ("b", "x" * 60, 50, None, None), ("c", "short", 50, 5, []), ("d", None, 50, 5, None), ("e", "y" * 60, None, 5, None), ("f", "z" * 60, 20, 15, None), ("g", "w" * 30, 20, 20, None), ("h", "v" * 9, 0, -4, None)]
    df = spark.createDataFrame(rows, f"id string, text string, most int, shared int, source_spans {spans}").withColumn("n", F.length("text"))
    out = splitting.split_items(df, "text", "most", "shared", ["id", "n", "source_spans"]).withColumn("spans", splitting.mapped_spans("source_spans", "n", "id")).collect()
    assert {r.id: r.overlap for r in out} == {"a": 5, "b": 0, "f": 15, "g": 19, "h": 0}
    for r in out:
        assert rows[ord(r.id) - 97][1][r.start : r.end] == r.text
        covered = sum(s.end - s.start for s in r.spans)
        assert r.text and covered in (len(r.text), len(r.text) - 1)
    first = min((r for r in out if r.id == "a"), key=lambda r: r.piece)
    assert (first.spans[0].element_id, first.spans[0].start) == ("e1", 3) and [r.spans[0].element_id for r in out if r.id == "b"] == ["b", "b"]


# look-alikes

SAME = [
    ("ABC １２３", "ＡＢＣ\u3000123"), ("café", "cafe\u0301"), ("a b", "a\u00a0b"), ("word", "wo\u200brd"), ("word", "w\u00adord\ufeff"), ("aceop", "асеор"), ("no", "nο"), ("fish", "ﬁsh"), ("K", "\u212a"), ("a-b", "a‐b"), ("a-b", "a\u2011b"),
    ("比较", "⽐较"), ("见", "⻅"), ("a\nb", "a\r\nb"), ("é", "е\u0301"), ("ë", "ё"), ("nu", "n\u200du"), ("x", "\u200ex\u2060"), ("가", "\u1100\u1161"),
    ("x", "x\U000e0100"), ("v", "ѵ"), ("o", "օ"), ("n", "ո"), ("G", "Ꮐ"), ("word", "w\U000e0041ord"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("n", "ñ"), ("1", "2"), ("x2", "x²"), ("0", "O"), ("l", "1"), ("a-b", "a–b"), ("ı", "i"), ("👩🏽‍🔧", "👩🏽🔧"), ("a b", "ab"), ("①", "1"), ("ï", "i"), ("σ", "o"), ("г", "r"), ("𝐀", "A"), ("٠", "."), ("🏴\U000e0067\U000e0062\U000e007f", "🏴")]


def test_looks():
    t = lookalike.transducer(lookalike.confusables())
    for a, b in SAME:
        assert t.rewrite(a) == t.rewrite(b), (a, b)
    for a, b in DIFFERENT:
        assert t.rewrite(a) != t.rewrite(b), (a, b)
    assert t.rewrite("👩🏽‍🔧 é") == "👩🏽‍🔧 é" and t.rewrite("plain ascii") == "plain ascii"
    rnd = random.Random(6)
    pool = "".join(a + b for a, b in SAME + DIFFERENT)
    for _ in range(300):
        text = "".join(rnd.choice(pool) for _ in range(20))
        assert t.rewrite(t.rewrite(text)) == t.rewrite(text)


def test_same_look_pairs_against_brute_force(spark):
    rnd = random.Random(9)
    forms = ["café", "cafe\u0301", "сafé", "cafe", "word", "wo\u200brd", "Word", "", None, "word "]
    rows = [("e", f"i{n:02d}", rnd.choice(forms), "clash") for n in range(60)]
    df = spark.createDataFrame(rows, "kind string, id string, text string, look string")
    got = {(r.id_a, r.id_b) for r in lookalike.same_look(lookalike.looks(df.drop("look"), ["kind", "id"], "text").where("look is not null"), "kind", "id").collect()}
    t = lookalike.transducer(lookalike.confusables())
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[2] is not None and b[2] is not None and a[2] != b[2] and t.rewrite(a[2]) == t.rewrite(b[2])}
    assert got == want and want
    links = {k: sum(k in pair for pair in want) for pair in want for k in pair}
    rows = lookalike.classes(lookalike.looks(df.drop("look"), ["kind", "id"], "text").where("look is not null"), "kind", "id").collect()
    assert {r.id: r.links for r in rows} == links and len(rows) == len(links)
    assert all((a.class_id == b.class_id) == (t.rewrite(texts[a.id]) == t.rewrite(texts[b.id])) for texts in [{r[1]: r[2] for r in df.collect()}] for a in rows for b in rows)
    odd = [(1, "ａ"), (2, None), (3, ""), (4, "Привет, мир"), (5, "Пpивет"), (6, "раypal"), (7, "Καλημέρα"), (8, "x\u200b\u00a0y")]
    out = lookalike.consistent(spark.createDataFrame(odd, "id int, text string"), ["id"], "text").orderBy("id").collect()
    assert [r.normal for r in out] == ["a", None, "", "Привет, мир", "Привет", "paypal", "Καλημέρα", "x y"]
    assert [r.consistent for r in out[:3]] == ["a", None, ""] and out[4].consistent == t.rewrite("Привет")


# markup


@pytest.mark.parametrize(
    "text,kinds,clean",
    [
        ("<h2>T</h2><p>a <b>b</b> &amp; c<br>d</p>", ["html"], "## T\na b & c\nd"), ("x<!-- no --> y &nbsp;z", ["html"], "x y z"), ("cut <img src='a.png'", ["html"], "cut"),
        ("## T\n\n**bold** and [link](u) ![i](u)", ["markdown"], "## T\nbold and link i"), ("- [x] a\n- **b**: c", ["markdown"], "- a\n- b: c"), ("t[^1]\n\n[^1]: note", ["markdown"], "t\nnote"), ("a `x<b>` c", ["markdown"], "a `x<b>` c"),
        ("t\n\n```py\n<b>[[x]]</b>\n```", ["markdown"], "t\n```\n<b>[[x]]</b>\n```"), ("<pre><code>a = [[1]]</code></pre>", ["html"], "```\na = [[1]]\n```"), ("| a | b |\n|---|:--:|\n| 1 | 2 |", ["markdown"], "| a | b |\n| 1 | 2 |"),
        ("== T ==\n'''b''' [[a|c]] {{x|y}}\n[[Category:Z]]", ["wiki"], "# T\nb c"), ("{|\n! h\n|-\n| c\n|}\ntext", ["wiki"], "| h |\n| c |\ntext"),
        ("\\section{T}\n\\textbf{b}~\\ref{x} $x^2$", ["latex"], "# T\nb $x^2$"), ("\\begin{equation}\na = b\n\\end{equation}\nt", ["latex"], "$$ a = b $$\nt"), ("{\\em x} \\[ y \\]", ["latex"], "x\n$$ y $$"),
        ("<div>\n\\cite{a} see [[b]]\n</div>", ["html", "latex", "wiki"], "see b"),
    ],
)
def test_markup(text, kinds, clean):
    got = markup.analyse(text)
    assert got[0] == kinds and re.sub(r"\n+", "\n", got[1]) == clean


@pytest.mark.parametrize("text", ["(if x<y then y>x)", "(36 < 40 and 36 > 1)", "a & co., 12%", "(a^2 + b^2)", "($27 or $32)", "(C:\\Peal\\10)", "(27 * 3 * 2 = 162)", "(~22 km)", "(no. #86)", "{7; 8}", "[17]", "(*see remark)", "(43|44)", "file_v31_final.txt", "a--b", "– item", None, "", "  "])
def test_no_markup(text):
    assert markup.analyse(text)[:2] == ([], text)


PROSE = "The crew of the harbour keeps the gauge in the yard and it is read by all of them at noon."


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("gauge _two_", ["markdown"]), (f"{PROSE}\ngauge _two_\n{PROSE}", []), (f"<b>{PROSE}</b>\ngauge _two_\n{PROSE}", ["html", "markdown"]), (f"{PROSE}\ngauge _two_\n<b>{PROSE}</b>", ["html", "markdown"]),
        (f"{PROSE}\ngauge <b>two</b>\n{PROSE}", ["html"]), (PROSE.replace("gauge", "*gauge*"), ["markdown"]), (f"{PROSE}\ngauge _two_", []), (f"{PROSE}\n\n(x) a_b $c_d$\n\nnote _two_\n{PROSE}", []), (f"{PROSE}\nnote\nR&amp;D", []), ("note\nR&amp;D", ["html"]),
    ],
)
def test_neighbours_decide_short_blocks(text, kinds):
    """A short block whose marks ordinary writing uses too is markup or plain with its neighbours, and so are the row and the text."""
    got, clean, _ = markup.analyse(text)
    assert got == kinds and ("gauge _two_" not in text or ("gauge two" in clean) == ("markdown" in kinds))


@pytest.mark.parametrize("text", [f"Copy it to C:\\temp\\new{{dir}} first. {PROSE}", "\\\\server\\share{x}", "D:\\left\\alpha"])
def test_paths_are_no_markup(text):
    assert markup.analyse(text)[:2] == ([], text)


def test_second_pass():
    assert markup.second_pass(["residue", "short", "residue"]) == ["residue"] * 3
    assert markup.second_pass(["text", "short", "residue", "doubtful"]) == ["text", "text", "residue", "text"]
    assert markup.second_pass(["short"]) == ["text"] and markup.second_pass([]) == []


@pytest.mark.parametrize(
    "text,kept",
    [
        ("Sales by year and office.\n{|\n! Year !! Sum\n|-\n| 12 || 34\n|-\n| 56 || 78\n|}", ["12 | 34", "56 | 78"]),
        ("<p>The years are</p><ul><li>2024</li><li>2025</li></ul>", ["- 2024", "- 2025"]),
        ("<p>The sums are</p><table><tr><td>12</td><td>34</td></tr></table>", ["12", "34"]),
        ("The answers are\n\\begin{itemize}\n\\item 42\n\\end{itemize}", ["42"]),
        ("The text before it.\n== 3.2 ==\nThe text after it.", ["# 3.2"]),
    ],
)
def test_figures_alone_are_content(text, kept):
    clean = markup.analyse(text)[1]
    assert all(x in clean for x in kept), clean
    assert markup.first_pass("table", "| - | - |", True) == "residue"


def test_found_and_clean_take_the_same_row(spark, tmp_path):
    """Of an element's rows the earliest counts in both, prose or not; rows of one time are told apart by what they hold."""
    import datetime as dt

    from docspark.llm import queries

    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", "table", "<b>x</b>", None, at(1)), ("a", "paragraph", "<i>y</i>", None, at(2)), ("b", "paragraph", "<b>x</b>", None, at(1)), ("b", "paragraph", "[[z]] w", None, at(1)), ("c", "paragraph", "<b>x</b>", '{"kind": "code_block"}', at(1)), ("d", "paragraph", None, None, at(1)), ("e", None, "{{x}} t", None, None)]
    df = spark.createDataFrame(rows, "element_id string, type string, content string, metadata string, recorded_at timestamp")
    for n, part in enumerate((df, df.orderBy(F.desc("content")).coalesce(1))):
        part.write.parquet(str(tmp_path / str(n) / "elements.parquet"))
    found = [{(r.element_id, r.markup) for r in queries.p2_found(spark, str(tmp_path / n)).collect()} for n in "01"]
    clean = [{r.element_id: (list(r.markup), r.clean) for r in queries.p2_clean(spark, str(tmp_path / n)).collect()} for n in "01"]
    assert found[0] == found[1] == {(k, m) for k, (kinds, _) in clean[0].items() for m in kinds} and clean[0] == clean[1] and set(clean[0]) == {"b", "d", "e"}


def test_pieces_of_the_earliest_row(spark, tmp_path):
    """Whatever the layout, of a key's rows the earliest is split; a row without a time comes last, and alone it counts."""
    import datetime as dt

    from docspark.llm import queries

    at = lambda d: dt.datetime(2024, 1, d)
    spark.createDataFrame([("split", "paragraph", "code points", 30, 5), ("split", "chunk", "code points", 40, 8), ("pack", "document", "tokens", 9, 0)], "use_for string, item_type string, unit string, capacity int, overlap int").write.parquet(str(tmp_path / "size_limits.parquet"))
    rows = [("a", "paragraph", "x" * 31, at(1)), ("a", "paragraph", "y" * 31, at(1)), ("a", "paragraph", "z" * 90, at(2)), ("b", "paragraph", "x" * 31, None), ("b", "paragraph", "x" * 9, at(1)), ("c", "paragraph", "w" * 31, None), ("d", "table", "w" * 99, at(1)), ("e", None, "w" * 99, at(1)), ("c", "paragraph", "w" * 31, None)]
    chunks = [("k", "t" * 41, (None, None), None, at(1)), ("l", "t" * 41, (50, 41), None, at(1)), ("m", "t" * 41, (20, 41), None, at(1)), ("n", None, None, None, at(1))]
    e = spark.createDataFrame(rows, "element_id string, type string, content string, recorded_at timestamp")
    c = spark.createDataFrame(chunks, "chunk_id string, text string, metadata struct<max_chars:int,char_count:int>, source_spans array<struct<element_id:string,start:int,end:int>>, recorded_at timestamp")
    e.write.parquet(str(tmp_path / "elements.parquet")), c.write.parquet(str(tmp_path / "chunks.parquet"))
    first = queries.p3_pieces(spark, str(tmp_path)).collect()
    e.orderBy(F.desc("content")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "elements.parquet"))
    assert {tuple(map(str, r)) for r in first} == {tuple(map(str, r)) for r in queries.p3_pieces(spark, str(tmp_path)).collect()}
    assert {(r.item_kind, r.item_id) for r in queries.p3_found(spark, str(tmp_path)).collect()} == {("element", "a"), ("element", "c"), ("chunk", "k"), ("chunk", "m")}
    assert {r.overlap for r in first if r.item_id == "m"} == {8} and len([r for r in first if r.item_id == "c"]) == 2


def test_markup_rows(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "k"), (2, None, "k"), (3, "plain", "k"), (4, "", "k")], "id int, content string, kinds string")
    assert {r.id: list(r.kinds) for r in markup.kinds_of(df.drop("kinds"), ["id"], "content").collect()} == {1: ["html"], 2: [], 3: [], 4: []}
    got = {r.id: (list(r.markup), r.clean, [b.role for b in r.blocks]) for r in markup.clean(df, ["id"], "content").collect()}
    assert got == {1: (["html"], "x", ["text"]), 2: ([], None, []), 3: ([], "plain", ["text"]), 4: ([], "", [])}


# truncation


@pytest.mark.parametrize(
    "text,state",
    [
        ("A whole sentence.", "PROSE"), ("x\n- item", "ITEM"), ("Figure 3: caption", "LABEL"), ("t\n| a | b |\n| - | - |\n| c | d |", "ROW"), ("t\n| a | b |\n| - | - |\n| c |", "PART"), ("| a | b |\n| c | d", "PART"),
        ("| a | b | c |\n| - | - | - |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| a | b |\n| --- | --- |\n| 1 | 2 |", "ROW"), ("| a |\n|", "PART"), ("```py\nx = 1", "OPEN"), ("```\nx\n```", "SHUT"), ("```\nx\n``", "OPEN"),
        ("Yours\nQuay team, 2024-01-02", "SIGNED"), ("On the quay, 2024-01-02 it rained", "PROSE"), ("Page 3 of 12", "PAGED"), ("第 3 页，共 9 页", "PAGED"), ("| a | b\\|", "PART"),
    ],
)
def test_states(text, state):
    """The state of a text's end, and that training sees the same one there, whatever else is in the line."""
    *_, (body, kind, head) = truncation.lines(text)
    assert truncation.last_state(body, kind, head) == getattr(truncation, state) == truncation.states(body, kind, head)[-1]


def test_contexts_are_the_same_in_training_and_scoring():
    text = "Short\n- item 12 of 7\nA longer line of prose, in 2024 and (later).) He said so.\n| a | b |\n| - | - |\n| cell | 12 |\n```\ncode\n```\nend"
    trained = [h[:, -1].tolist() for h, _, _ in truncation.training(text)]
    every = list(truncation.lines(text))
    scored = truncation.tails([b for b, _, _ in every], [truncation.last_state(*x) for x in every]).T.tolist()
    assert len(trained) == len(scored) == 10 and trained[:-1] == scored[:-1] and trained[-1] == scored[-1][:1]
    assert truncation.canonical('on 12 May 2024 (he said "yes.")') == "on 0 May 0 (he said \"yes."
    ends = [sum(e) for _, e, _ in truncation.training("One. Two three\n- a, b\n```\nx\n```\nlast")]
    assert ends == [2, 1, 0, 0, 1, 1]


def test_held_out_cuts(spark):
    """Cuts at the limit of a source, cuts in transfer, a source's sign, and whole texts of the same lengths."""
    rnd = random.Random(11)
    nouns, verbs = ["report", "margin", "ledger sheet", "page count", "wiring plan", "index", "valve", "summary"], ["covers", "replaces", "confirms", "skips", "outlines"]
    sentence = lambda: f"The {rnd.choice(nouns)} {rnd.choice(verbs)} the {rnd.choice(nouns)} {rnd.choice(['on the last page', 'before the next run', 'with a small offset'])}."
    text = lambda n: "\n".join(" ".join(sentence() for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    rows, cut = [], set()
    for n in range(600):
        body, source = text(rnd.randrange(2, 14)), rnd.choice(["free", "limit", "sign"])
        if source == "limit" and len(body) > 400:
            body = body[:400]
        elif source == "sign" and len(body) > 500:
            body = body[:500] + " [...]"
        elif source == "free" and n % 9 == 0:
            body = body[: rnd.randrange(50, len(body) - 1)]
        whole = re.search(r"\.\s*$", body) and not body.endswith("[...]")
        if not whole:
            cut.add(n)
        rows.append((n, body, rnd.choice(["en", "EN", None]), source, "c"))
    rows += [(1000, None, "en", "free", "c"), (1001, "  ", "en", None, "c"), (1002, "", None, None, "c"), (1003, "Whole text.", None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cut string")
    got = {r.doc_id: r.cut for r in truncation.truncated(df, "doc_id", "text", "lang", "source").collect()}
    found = {k for k, v in got.items() if v}
    assert set(got) == set(range(600)) | {1003}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.02 * 600
    assert truncation.truncated(df.limit(0), "doc_id", "text", "lang", "source").count() == 0


def final(key, kind="prose", ends=5.0, letter=None, stops=5.0, suffix="", chars=None, source="s"):
    n = chars or 1000 + 37 * key
    return (key, "en", kind, suffix, ends, ends if letter is None else letter, stops, n, n, key, source, None, None, None)


def test_log_odds_decide(spark):
    """Whatever the form: low odds are a cut, high odds are none; the last letter counts in prose, items and captions alone."""
    texts = [final(1, ends=2.0), final(2, ends=-9.0), final(3, stops=-19.0), final(4, "list", ends=-4.0), final(5, "list", ends=-9.0), final(6, "table", ends=-3.0), final(7, "table", stops=-19.0), final(8, "code", ends=3.0), final(9, ends=9.0, suffix="\ufffd", letter=5.0)]
    counts = [(None, "en", k, *[None] * 8, w, step, n) for k in ("prose", "list") for w in ("ends", "stops") for step, n in ((-100, 20), (0, 2000))]
    got = {r.key for r in truncation.judge(spark.createDataFrame(texts + counts, truncation.FINAL)).where("cut").collect()}
    assert got == {2, 3, 5, 6, 9}


def test_thresholds_are_exact(spark):
    counts = [(None, tag, "prose", *[None] * 8, "ends", step, n) for tag, rows in (("en", [(-100, 4), (-99, 3), (5, 993)]), ("de", [(-40, 100), (0, 100)])) for step, n in rows]
    got = {(r.tag, r.kind): (r.low_ends, r.low_stops) for r in truncation.thresholds(spark.createDataFrame(counts, truncation.FINAL)).collect()}
    assert got == {("en", "prose"): (pytest.approx(-99 * truncation.STEP), None), ("*", "prose"): (pytest.approx(-99 * truncation.STEP), None)}


def test_limits_of_any_size(spark):
    """A limit of 40 characters is found, and even odds are asked for there."""
    rnd = random.Random(3)
    rows = [final(n, chars=40, ends=-1.0 if n % 2 else 1.0) for n in range(60)] + [final(100 + n, chars=rnd.randrange(20, 400), ends=-1.0) for n in range(40)] + [final(200 + n, chars=rnd.randrange(20, 400), ends=-1.0, source="t") for n in range(40)]
    df = spark.createDataFrame(rows, truncation.FINAL)
    assert {(r.source, r.size) for r in truncation.limits(df).where("unit = 'chars'").collect()} == {("s", 40)}
    low = [(None, "en", "prose", *[None] * 8, "ends", -40, 900)]
    got = truncation.judge(df.union(spark.createDataFrame(low, truncation.FINAL))).where("cut").collect()
    assert {r.key for r in got if r.key < 100} == set(range(1, 60, 2)) and not any(r.source == "t" for r in got)


def prose(spark, n=260):
    rnd = random.Random(12)
    noun = lambda: rnd.choice(["sheet", "harbour gate", "valve", "pump", "ledger"])
    sentence = lambda: f"The {noun()} {rnd.choice(['covers', 'opens', 'holds'])} the {noun()} {rnd.choice(['today', 'on page 7', 'at noon'])}."
    rows = [(i, "\n".join(" ".join(sentence() for _ in range(rnd.randrange(1, 3))) for _ in range(6))[: None if i % 13 else rnd.randrange(80, 160)], "en") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))


def test_the_same_rows_whatever_the_layout(spark):
    df = prose(spark)
    models = [truncation.fit(x, "doc_id", "text", "lang", 60) for x in (df.repartition(1), df.repartition(7), df.orderBy("text"))]
    assert all((m.keys == models[0].keys).all() and (m.n == models[0].n).all() and (m.counts["ends"] == models[0].counts["ends"]).all() for m in models)
    cut = [{r.doc_id for r in truncation.truncated(x, "doc_id", "text", "lang", "source").where("cut").collect()} for x in (df.repartition(1), df.repartition(7))]
    assert cut[0] == cut[1] and len(cut[0]) >= 12


def test_nothing_is_cut_without_the_model(spark):
    df, m = prose(spark), truncation.fit(prose(spark), "doc_id", "text", "lang")

    class Sure(truncation.Model):
        def log_odds(self, contexts, what="ends"):
            return np.full(contexts.shape[1], 4.0)

    assert truncation.truncated(df, "doc_id", "text", "lang", "source", Sure(m.keys, m.n, *m.counts.values())).where("cut").count() == 0
    assert truncation.truncated(df, "doc_id", "text", "lang", "source", m).where("cut").count() >= 12
    long = spark.createDataFrame([(1, "The sheet opens. " * 20_000, "en", "s"), (2, "x" * 200_000, None, None), (3, "\ud83d".encode("utf-8", "replace").decode(), "en", "s")], "doc_id long, text string, lang string, source string")
    assert truncation.truncated(long, "doc_id", "text", "lang", "source").count() == 3


def test_counts_of_many_lines_against_each_position():
    """What is counted at once is what `training` says of each position, whatever stands in the lines."""
    texts = ["One. Two three\n- a, b\n```\nx\n```\nlast", "a\0b c\n\0\0x y.\nend", "_ a_b. __c (x). ”)\n第 3 页，共 9 页\nYours, 2024-01-02\nPage 3 of 12\nfin", "He said (\"yes.”) 12.)34 ok。。a ok.）x\n| a | b |\n| - | - |\n| c\\| | d |\n|\nz"]
    texts += ["".join(chr(c) for c in range(1, 0x3000) if c != 10) + "\nq", "The sheet opens. " * 100 + "\nend", ""]
    want: dict[int, list[int]] = {}
    for h, ends, stops in (x for t in texts for x in truncation.training(t)):
        for row in h.tolist():
            for key, e, s in zip(row, ends.tolist(), stops.tolist(), strict=True):
                want[key] = [a + b for a, b in zip(want.get(key, [0, 0, 0]), (1, e, s), strict=True)]
    got: dict[int, list[int]] = {}
    for _, h, *counts in truncation.counted(iter(texts)):
        for key, *x in zip(h.tolist(), *(c.tolist() for c in counts), strict=True):
            got[key] = [a + b for a, b in zip(got.get(key, [0, 0, 0]), x, strict=True)]
    assert got == want


def test_the_model_is_that_of_all_texts(spark):
    """Each text is in the model, of a language with many texts too, and each score is the one that the counts of all texts give; a line
    end's without the position itself."""
    df = prose(spark, 1500)
    texts = [r.text for r in df.collect()]
    model = truncation.fit(df, "doc_id", "text", "lang")
    assert model.n.sum() == sum(h.size for t in texts for h, _, _ in truncation.training(t))
    cuts = Cuts(spark)
    rows = cuts.cut(truncation.contexts(df, "doc_id", "text", "lang", F.lit("s")))
    scored = truncation.scored(rows, df.select("text"), cuts)
    got = {r.key: (r.ends, r.letter, r.stops) for r in scored.where("n is null").collect()}
    asked = {r.key: r for r in rows.where("what = 'text'").collect()}
    keys = sorted(asked)
    h, low = (np.array([[r[c + str(k)] for r in (asked[x] for x in keys)] for k in (0, *truncation.ORDERS)]).view(np.uint64) for c in "hl")
    want = zip(model.log_odds(h).tolist(), model.log_odds(low).tolist(), model.log_odds(low, "stops").tolist(), strict=True)
    assert len(got) == 1500 and all(got[k] == pytest.approx(x) for k, x in zip(keys, want, strict=True))
    lone = rows.where("what = 'ends'").collect()
    h, n = np.array([[r[f"h{k}"] for r in lone] for k in (0, *truncation.ORDERS)]).view(np.uint64), np.array([r.n for r in lone])
    p = np.full(len(n), truncation.BASE)
    for row in h:
        i = np.searchsorted(model.keys, row)
        assert (model.keys[i] == row).all()
        p = (model.counts["ends"][i] - 1 + truncation.BACKOFF * p) / (model.n[i] - 1 + truncation.BACKOFF)
    steps: dict[int, int] = {}
    for step, k in zip(np.floor(np.log((x := np.clip(p, 1e-12, 1 - 1e-12)) / (1 - x)) / truncation.STEP).astype(int).tolist(), n.tolist(), strict=True):
        steps[step] = steps.get(step, 0) + k
    counts = {r.step: r.n for r in scored.where("n is not null and what = 'ends'").groupBy("step").agg(F.sum("n").alias("n")).collect()}
    assert sum(counts.values()) == sum(len(list(truncation.lines(t))) - 1 for t in texts) and counts == steps
