import random
import re

import pytest

from docspark.operators.chunking import chunk, pack, split_long
from docspark.types import ELEMENT

BLANKS = [" ", "\t", "\n", "\r", "\u00a0", "\u2003", "\u3000"]
TEXTS = [
    ("north harbour gate", 9), ("harbourmaster", 6), ("gate two, pier nine", 7), ("pier" + " " * 50 + "nine" * 12, 32), ("\n tide tables\t", 40), ("\u3000 \n", 9), ("", 40), ("tide", 4), ("tides", 4),
    ("港口的潮水今晚会很高所以船只不要离开", 7), ("港口 tide 潮水 low", 7), ("Low tide. High tide! Is it noon? It is.", 12), ("One very long sentence without any end mark at all and so on", 10), ("Short. " + "x" * 40 + " y. Done.", 16),
    *[(f"anchor{b}chainlocker", 10) for b in BLANKS],
]


def slow_pieces(text, limit):
    """The same rules position by position: sentences first, then windows, then joining by one space while it fits."""
    text = text.strip()
    if len(text) <= limit:
        return [(text, None)] if text else []
    sentences, held = [], ""
    for n, c in enumerate(text):
        if c.isspace() and held.rstrip() and held.rstrip()[-1] in "。！？!?." and not held.rstrip() == "":
            if text[n - 1].isspace():
                continue
            sentences.append(held)
            held = ""
        elif not (c.isspace() and not held):
            held += c
    pieces = []
    for sentence in [*sentences, held]:
        if len(sentence) <= limit:
            pieces += [(sentence, None)] if sentence else []
            continue
        while len(sentence) > limit:
            blank = next((k for k in range(limit, limit // 2 - 1, -1) if sentence[k].isspace()), None)
            cut, after = (limit, limit) if blank is None else (blank, blank + 1)
            rest = sentence[after:].lstrip()
            pieces.append((sentence[:cut].rstrip(), "forced_char" if blank is None else "whitespace" if rest else None))
            sentence = rest
        pieces += [(sentence, None)] if sentence else []
    out = []
    for piece in pieces:
        if out and len(out[-1][0]) + 1 + len(piece[0]) <= limit:
            out[-1] = (out[-1][0] + " " + piece[0], piece[1])
        else:
            out.append(piece)
    return out


def random_texts():
    rnd = random.Random(21)
    words = ["tide", "harbourmaster", "潮水", "pier.", "noon!", "x" * 45, "a"]
    return [("".join(rnd.choice(words) + rnd.choice(BLANKS) for _ in range(rnd.randrange(1, 30))), rnd.randrange(4, 40)) for _ in range(300)]


@pytest.mark.parametrize("text,limit", TEXTS)
def test_long_text(text, limit):
    assert [(p, b) for p, b, _, _ in split_long(text, limit)] == slow_pieces(text, limit)


def test_long_text_against_brute_force():
    for text, limit in random_texts():
        assert [(p, b) for p, b, _, _ in split_long(text, limit)] == slow_pieces(text, limit), (text, limit)


def test_spans_point_into_the_text():
    assert [x[2:] for x in split_long("Low tide. High tide. Slack water.", 21)] == [(0, 20), (21, 33)]
    for text, limit in TEXTS + random_texts():
        t = text.strip()
        assert all(re.sub(r"\s", "", t[s:e]) == re.sub(r"\s", "", p) for p, _, s, e in split_long(text, limit))


def elements(*rows, **locators):
    return [{"ord": n, "element_id": f"e{n}", "type": t, "content": c, "resource_path": None, "parent_id": None, "source_locator": locators.get(f"e{n}"), "confidence": None, "metadata": None} for n, (t, c) in enumerate(rows)]


def test_packing():
    got = pack(elements(("paragraph", "w" * 75)), "d", "text", 32)
    assert [len(c["text"]) for c in got] == [32, 32, 11] and [c["metadata"]["split_boundary_after"] for c in got] == ["forced_char", "forced_char", None]
    got = pack(elements(("paragraph", "The ebb begins at noon. The flood follows. Slack water is brief.")), "d", "text", 32)
    assert [c["text"] for c in got] == ["The ebb begins at noon.", "The flood follows.", "Slack water is brief."] and {c["metadata"]["strategy"] for c in got} == {"long_paragraph_sentence_split"}
    got = pack(elements(("list_item", "buoy"), ("table", "| depth |"), ("caption", "Table 4: depth"), ("paragraph", "light")), "d", "text", 32)
    assert [(c["text"], c["metadata"]["strategy"]) for c in got] == [("buoy", "sequential"), ("| depth |", "isolated_table"), ("Table 4: depth", "isolated_caption"), ("light", "sequential")]
    got = pack(elements(("paragraph", "\n\t"), ("paragraph", "w" * 40), ("paragraph", None)), "d", "text", 32)
    assert [c["chunk_id"] for c in got] == ["d::c0000", "d::c0001"]
    got = pack(elements(("heading", "Tides"), ("paragraph", "  ebb "), ("image", "no"), ("heading", "Piers"), ("paragraph", None)), "d", "text", 32)
    assert [(c["text"], c["source_element_ids"]) for c in got] == [("Tides ebb", ["e0", "e1"]), ("Piers", ["e3"])]
    assert got[0]["source_spans"][1] == {"element_id": "e1", "start": 2, "end": 5}


def test_notebook_cells_stay_apart():
    rows = elements(("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c"), ("paragraph", "d"), e0={"cell_index": 0}, e1={"cell_index": 0}, e2={"cell_index": 1})
    assert [c["text"] for c in pack(rows, "d", "ipynb", 32)] == ["a b", "c", "d"]
    assert [c["text"] for c in pack(rows, "d", "html", 32)] == ["a b c d"]


def test_column(spark):
    df = spark.createDataFrame([("d", "text", elements(("heading", "H"), ("paragraph", "é" * 100)), 1), ("n", None, None, 2), ("z", "text", [], 3)], f"document_id string, source_type string, elements array<{ELEMENT}>, chunks int")
    got = {r.document_id: r.chunks for r in chunk(df, "elements", "document_id", "source_type", 40).collect()}
    assert [c.text for c in got["d"]] == ["H", "é" * 40, "é" * 40, "é" * 20] and got["n"] == [] and got["z"] == []
    with pytest.raises(ValueError):
        chunk(df, "elements", "document_id", "source_type", 31)


def test_preservation_of_every_document(spark, tmp_path):
    from docspark.queries import reference

    texts = {1: "# Head\n\nOne two. " + "Three four. " * 200, 2: "# Head\n\nOne two.\n\n- a\n- b\n\nLast line", 3: "plain", 4: None, 5: "  "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = reference.chunk_preservation_all(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.source_type) for r in rows} == {(n, t) for n in (1, 2, 3) for t in ("text", "markdown")}
    assert all(r.in_chunks == r.in_elements for r in rows), rows
    assert all(r.in_elements == len("".join(texts[r.doc_id].split())) for r in rows if r.source_type == "text")
