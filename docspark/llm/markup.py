"""Markup residue of HTML, Markdown, wiki and LaTeX in prose: which kinds a text holds, and the clean text.

Block rules in two passes decide twice. First, which blocks of the text as it came hold markup at all: what can't be anything else
(a tag, an environment, a link in brackets) decides for its block; a mark that ordinary writing uses too (a star, an underscore, a
dollar, an ampersand) is markup in a block of running prose, told by length and stop-word density, and in a short or doubtful block
if the nearest decided neighbours hold markup. Blocks decided to be plain stay as they are. A scanner then finds code blocks and the
tokens outside of them; each token says what of it remains. Second, which blocks of the rewritten text, whose roles (heading, list,
code, formula, table, text) stay recognisable, are text: by length, stop-word density and link density, and by neighbours for short
and doubtful blocks. Those labelled residue are left out. Blocks that no token touched are never residue.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML.
HTML_NAMES = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta meter nav noscript object ol optgroup option output p param picture pre progress q "
    "rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
#: Function words of the languages met, for the density of stop words.
STOP_WORDS = set(
    "the a an of to in on and or is are was for with at by as that which it this from be not all no "
    "der die das den dem des ein eine und oder ist sind in im auf mit von zu für nicht alle wie ohne "
    "el la los las un una de del en y o es son con por para que se al sin según "
    "le les des du une et ou est sont dans sur avec par pour qui que au aux sans bien "
    "и в на с по для не что из от до без или как это".split()
)
STOP_CHARACTERS = set("的了在是和与或不有对从到为并而之其此见如")
#: First pass: words from which a block is long, and the densities that decide.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 4, 12, 0.12, 0.22, 0.5

_ATTRIBUTE = r"(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+)|\s+(?:checked|compact|disabled|hidden|nowrap|noshade|readonly|selected))"
_NAME = rf"(?:{'|'.join(sorted(HTML_NAMES, key=len, reverse=True))})"
TAG = re.compile(rf"<(?P<close>/?)(?P<tag>{_NAME}){_ATTRIBUTE}*\s*/?>|<(?P<open>{_NAME}){_ATTRIBUTE}+\s*/?(?=$|\n)", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<\?xml[^>]*>|<!\[CDATA\[|\]\]>", re.I | re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
#: Commands of LaTeX that stand without an argument in braces.
_STYLES = "text[a-z]{2}|emph|underline|overline|title|author|date|caption|url|href|mbox|mathrm|mathbf|mathit|sqrt|frac|footnotesize|centerline"
_BARE = "item|em|bf|it|tt|sc|par|noindent|newline|newpage|linebreak|pagebreak|maketitle|tableofcontents|hline|centering|LaTeX|TeX|ldots|dots|cdot|cdots|times|leq|geq|neq|approx|alpha|beta|gamma|delta|epsilon|lambda|mu|sigma|omega|pi|theta|sum|int|infty|partial|quad|qquad|left|right|bigskip|medskip|smallskip"

CODE = (
    ("markdown", re.compile(r"^(?P<a>[ \t]*(?P<f>`{3,}|~{3,})(?![`~])[^\n`]*\n)(?P<body>.*?)(?P<z>^[ \t]*(?P=f)[ \t]*\r?$|\Z)", re.M | re.S)),
    ("html", re.compile(r"(?P<a><pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?|<code\b[^<>]*>)(?P<body>.*?)(?P<z>(?:</code>\s*)?</pre>|</code>|\Z)", re.I | re.S)),
    ("wiki", re.compile(r"(?P<a><(?P<f>syntaxhighlight|source|nowiki)\b[^<>]*>)(?P<body>.*?)(?P<z></(?P=f)>|\Z)", re.I | re.S)),
    ("latex", re.compile(r"(?P<a>\\begin\{(?P<f>verbatim|lstlisting|minted)\}[^\n]*)(?P<body>.*?)(?P<z>\\end\{(?P=f)\}|\Z)", re.S)),
    ("markdown", re.compile(r"(?P<a>(?<!`)(?P<f>`{1,2})(?!`))(?P<body>[^`\n]+)(?P<z>(?<!`)(?P=f)(?!`))")),
)
#: (kind, pattern, what remains: a group's name, a fixed text, or a function's name below). A kind with a question mark: ordinary
#: writing uses such marks too, so the block decides.
TOKENS = (
    ("latex", re.compile(r"\\begin\{(?P<env>equation|align|gather|displaymath|math|eqnarray|multline)\*?\}(?P<in>.*?)(?:\\end\{(?P=env)\*?\}|\Z)", re.S), "formula"),
    ("latex", re.compile(r"\\\[(?P<in>(?:(?!\\\[).)+?)\\\]|\$\$(?P<in2>[^$]+)\$\$", re.S), "formula"),
    ("latex?", re.compile(r"\\\((?P<in>(?:(?!\\\().)+?)\\\)|\$(?P<in2>(?=[^$\n]*[\\^_{}])[^\s$](?:[^$\n]*[^\s$\\])?)\$(?!\d)"), "inline"),
    ("latex", re.compile(r"\\(?P<cmd>part|chapter|section|subsection|subsubsection|paragraph)\*?\{(?P<in>[^{}\n]*)\}"), "section"),
    ("latex", re.compile(r"[~ ]?\\(?:cite[a-z]*|ref|eqref|pageref|label|bibliography|bibliographystyle|input|include|usepackage|documentclass|includegraphics|vspace|hspace)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}"), ""),
    ("latex", re.compile(r"\\footnote\{(?P<in>[^{}\n]*)\}"), "note"),
    ("latex", re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?"), "\n"),
    ("latex", re.compile(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*"), "\n\ue004 "),
    ("latex", re.compile(r"\{\\(?:em|bf|it|tt|sc|rm|sf|sl|small|large|Large|tiny)\b\s*(?P<in>[^{}]*)\}"), "in"),
    ("latex", re.compile(rf"(?<![A-Za-z]:)(?<!\\)\\(?:{_STYLES})\*?(?:\[[^\]\n]*\])?\{{(?P<in>[^{{}}\n]*)\}}(?:\{{[^{{}}\n]*\}})*"), "in"),
    ("latex?", re.compile(r"(?<![A-Za-z]:)(?<![\w\\])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{(?P<in>[^{}\n]*)\}(?:\{[^{}\n]*\})*"), "in"),
    ("latex?", re.compile(rf"(?<![A-Za-z]:)(?<![\w\\])\\(?:{_BARE})(?![A-Za-z\\])"), ""),
    ("wiki", re.compile(r"^\{\|[^\n]*\n(?P<in>.*?)(?:^\|\}|\Z)", re.M | re.S), "wikitable"),
    ("wiki", re.compile(r"\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\}"), ""),
    ("wiki", re.compile(r"\[\[(?:File|Image|Category|Datei|Bild|Kategorie|Fichier|Catégorie|Archivo|Categoría|Файл|Категория|文件|分类)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", re.I), ""),
    ("wiki", re.compile(r"\[\[(?:[^\[\]|\n]*\|)?(?P<in>[^\[\]|\n]+)\]\](?!\()"), "link"),
    ("wiki", re.compile(r"(?<!')(?P<q>'{2,3}|'{5})(?!['\s])(?P<in>(?:[^'\n]|'(?!'))*?[^'\s])(?P=q)(?!')"), "in"),
    ("wiki", re.compile(r"(?<!')(?P<q>'{2,3}|'{5})(?!['\s])(?P<in>(?:[^'\n]|'(?!'))*?[^'\s])(?P=q)(?!')"), "in"),
    ("wiki", re.compile(r"^(?P<eq>={1,6})[ \t]*(?P<in>[^=\n]+?)[ \t]*(?P=eq)[ \t]*\r?$", re.M), "heading"),
    ("wiki", re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+(?P<in>[^\]\n]*))?\]"), "link"),
    ("wiki", re.compile(r"<ref\b[^<>]*?/>|<ref\b[^<>]*>(?:(?!<ref\b).)*?</ref>|<references\s*/>", re.I | re.S), ""),
    ("wiki", re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|GALLERY)__"), ""),
    ("html", COMMENT, ""),
    ("html", TAG, "tag"),
    ("html?", ENTITY, "entity"),
    ("markdown", re.compile(r"!\[(?P<in>[^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\]\n]*\])"), "in"),
    ("markdown", re.compile(r"^[ \t]{0,3}\[\^[^\]\s]+\]:[ \t]*", re.M), ""),
    ("markdown", re.compile(r"^[ \t]{0,3}\[[^\]\n^]+\]:[ \t]*\S+(?:[ \t]+[\"'(][^\n]*)?[ \t]*\r?$", re.M), ""),
    ("markdown", re.compile(r"\[\^[^\]\s]+\]"), ""),
    ("markdown", re.compile(r"(?<!\[)\[(?P<in>[^\[\]\n]+)\](?:\([^()\s]*(?:\s+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])"), "link"),
    ("markdown", re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(?=\S)", re.M), "mark"),
    ("markdown", re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+", re.M), "- "),
    ("markdown?", re.compile(r"^[ \t]{0,3}>[ \t]?", re.M), ""),
    ("markdown", re.compile(r"^[ \t]*(?:\|[ \t]*)?(?::?-{2,}:?[ \t]*\|[ \t]*)+(?::?-{2,}:?[ \t]*)?\r?$\n?", re.M), ""),
    ("markdown", re.compile(r"(?<![\w*])(?P<s>\*\*\*|\*\*)(?![\s*])(?P<in>[^*\n]*[^\s*])(?P=s)(?!\*)|(?<![\w_])__(?![\s_])(?P<in2>[^_\n]*[^\s_])__(?![\w_])|(?<!~)~~(?![\s~])(?P<in3>[^~\n]*[^\s~])~~(?!~)"), "in"),
    ("markdown?", re.compile(r"(?<![\w*\\])\*(?![\s*=])(?P<in>[^*\n]*[^\s*])\*(?![\w*])|(?<![\w_\\])_(?![\s_])(?P<in2>[^_\n]*[^\s_])_(?![\w_])"), "in"),
    ("markdown", re.compile(r"^[ \t]*[-*+][ \t]+(?=\*\*|\[|`)", re.M), "- "),
    ("markdown?", re.compile(r"^[^\S\n]*\S[^\n]*\n(?P<u>={3,}|-{3,})[ \t]*\r?$", re.M), "setext"),
)
#: A text without any of these holds no token.
POSSIBLE = re.compile(r"[<&#*_~`\[\]{}|\\$]|''|==|^[ \t]*>|^[-=]{3}", re.M).search
HOLD = "\ue000"  # stands for a code block or formula while the rest is rewritten
HEAD, ITEM = "\ue003", "\ue004"  # headings and items made from other markup, so that no later pattern takes them for Markdown
BREAKING = {"p", "div", "br", "hr", "ul", "ol", "table", "tr", "dl", "dt", "dd", "blockquote", "section", "article", "header", "footer", "caption", "figure", "figcaption", "thead", "tbody", "form", "nav", "aside", "main", "center"}


class Scan:
    """One text: its kinds of markup, and the text with each token replaced by what remains of it."""

    def __init__(self, text: str):
        self.kinds: set[str] = set()
        self.held: list[tuple[str, str]] = []
        text = re.sub("[\ue000-\ue004]", "", text)
        for kind, pattern in CODE:
            text = pattern.sub(lambda m, kind=kind: self._code(kind, m), text)
        text = "\n".join(self._hold("plain", x) if label == "plain" else x for x, label in holding(text))
        for kind, pattern, rest in TOKENS:
            text = pattern.sub(lambda m, kind=kind.rstrip("?"), rest=rest: self._token(kind, rest, m), text)
        self.text = text.replace(HEAD, "#").replace(ITEM, "-")

    def _hold(self, role: str, text: str) -> str:
        self.held.append((role, text))
        return f"{HOLD}{len(self.held) - 1}{HOLD}"

    def _code(self, kind: str, m: re.Match) -> str:
        self.kinds.add(kind)
        body = m["body"].strip("\n\r")
        if kind == "html":
            body = html.unescape(body)
        return f"\n{self._hold('code', body)}\n" if "\n" in m.group(0) or m["a"].lower().startswith(("<pre", "\\begin")) else self._hold("inline code", body)

    def _token(self, kind: str, rest: str, m: re.Match) -> str:
        inner = next((v for k, v in m.groupdict().items() if k.startswith("in") and v is not None), "")
        whole = m.group(0)
        if rest == "entity" and whole[1] != "#" and whole[1:] not in html5:
            return whole
        if rest == "setext" and whole.lstrip().startswith("|"):
            return whole
        self.kinds.add(kind)
        if rest in ("in", "link"):
            return inner if rest == "in" else f"\ue001{inner}\ue002"
        if rest == "formula":
            return f"\n{self._hold('formula', inner.strip())}\n"
        if rest == "inline":
            return self._hold("inline formula", inner.strip())
        if rest == "section":
            return f"\n{HEAD * {'part': 1, 'chapter': 1, 'section': 1, 'subsection': 2}.get(m['cmd'], 3)} {inner}\n"
        if rest == "heading":
            return f"{HEAD * max(1, len(m['eq']) - 1)} {inner}"
        if rest == "mark":
            return whole.lstrip()
        if rest == "note":
            return f" ({inner})"
        if rest == "setext":
            return f"{HEAD} {whole.strip().splitlines()[0]}"
        if rest == "wikitable":
            rows = [re.sub(r"\s*(?:\|\||!!)\s*|^[|!]\s*", " | ", x).strip() for x in inner.split("\n") if x.strip() and not x.startswith(("|-", "|+", "|}"))]
            return "\n".join(f"{x} |" for x in rows)
        if rest == "entity":
            return html.unescape(whole).replace("\xa0", " ")
        if rest == "tag":
            name, close = (m["tag"] or m["open"]).lower(), bool(m["close"])
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                return "\n" if close else f"\n{HEAD * int(name[1])} "
            if name == "li":
                return "\n" if close else f"\n{ITEM} "
            if name in ("td", "th"):
                return " | "
            if name == "a":
                return "\ue002" if close else "\ue001"
            return "\n" if name in BREAKING else ""
        return rest


def features(block: str) -> tuple[int, float, float]:
    """(words, stop-word density, link density) of a block; \\ue001 and \\ue002 enclose links."""
    linked = sum(len(x) for x in re.findall("\ue001([^\ue002]*)", block))
    text = block.replace("\ue001", "").replace("\ue002", "")
    words = re.findall(r"[^\W\d_]+", text.lower())
    ideographs = [c for c in text if "㐀" <= c <= "鿿"]
    words = [w for w in words if not "㐀" <= w[0] <= "鿿"]
    count = len(words) + (len(ideographs) + 1) // 2
    stops = sum(w in STOP_WORDS for w in words) + sum(c in STOP_CHARACTERS for c in ideographs)
    return count, stops / count if count else 0.0, linked / max(1, len(text))


def first_pass(role: str, block: str, touched: bool) -> str:
    """text, residue, or what is decided by neighbours: short and doubtful."""
    if role in ("code", "formula"):
        return "text"
    words, stops, links = features(block)
    if not touched:
        return "text"
    if links > LINKS and words > SHORT:
        return "residue"
    if role in ("heading", "list", "table") or words < LONG:
        return "short" if words or any(map(str.isalnum, block)) else "residue"  # figures alone are content
    return "text" if stops >= STOP_HIGH else "doubtful" if stops >= STOP_LOW else "residue" if words > 3 * LONG and links > 0.2 else "doubtful"


def second_pass(labels: list[str]) -> list[str]:
    """Short and doubtful blocks take the label of the nearest decided neighbours: residue only between residue."""
    decided = ("text", "residue")
    left, right = list(labels), list(labels)
    for side, order in ((left, range(len(labels))), (right, range(len(labels) - 1, -1, -1))):
        near = None
        for i in order:
            near = labels[i] if labels[i] in decided else near
            side[i] = near
    return [x if x in decided else "residue" if a == b == "residue" else "text" for x, a, b in zip(labels, left, right, strict=True)]


def evidence(text: str) -> tuple[set[int], set[int]]:
    """The lines of a text that hold sure tokens, and those that hold marks which ordinary writing uses too."""
    sure, open_ = set(), set()
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    for kind, pattern, rest in TOKENS:
        for m in pattern.finditer(text):
            if rest == "entity" and m.group(0)[1] != "#" and m.group(0)[1:] not in html5 or rest == "setext" and m.group(0).lstrip().startswith("|"):
                continue
            within = range(bisect_right(starts, m.start()) - 1, bisect_right(starts, max(m.start(), m.end() - 1)))
            (open_ if kind.endswith("?") else sure).update(within)
    return sure, open_ - sure


def holding(text: str) -> list[tuple[str, str]]:
    """(line, label) of each line of a text: `markup`, or `plain` for a line whose only marks are such as ordinary writing uses.

    A line with a sure token is markup. One with open marks is markup if it is running prose; if it is short or its stop words don't
    tell, the nearest decided lines on both sides do, and it is plain between plain ones alone (or next to them, at an end). Lines
    without marks are plain if they are prose, and undecided if not.
    """
    every = text.split("\n")
    sure, open_ = evidence(text)
    labels = []
    for n, line in enumerate(every):
        words, stops, _ = features(line)
        prose = words >= LONG and stops >= STOP_LOW
        labels.append("markup" if n in sure or HOLD in line else "" if not line.strip() else "short" if n in open_ and not prose else "markup" if n in open_ else "plain" if prose else "short")
    before, after = list(labels), list(labels)
    for side, order in ((before, range(len(labels))), (after, range(len(labels) - 1, -1, -1))):
        near = ""
        for i in order:
            near = side[i] = labels[i] if labels[i] in ("markup", "plain") else near
    return [(x, "plain" if n in open_ and label == "short" and {a, b} - {""} == {"plain"} else "markup") for n, (x, label, a, b) in enumerate(zip(every, labels, before, after, strict=True))]


def analyse(text: str | None) -> tuple[list[str], str | None, list[tuple[str, str, str]]]:
    """(kinds in order, clean text, blocks as (role, label, text)). Null, empty and blank texts hold nothing and stay as they are."""
    if not text or not text.strip():
        return [], text, []
    if not POSSIBLE(text):
        return [], text, [("text", "text", text)]
    scan = Scan(text)
    if not scan.kinds:
        return [], text, [("text", "text", text)]
    blocks: list[list] = []
    original = set(text.split("\n"))
    for line in scan.text.split("\n"):
        body = line.strip()
        if not body:
            blocks.append(["", "", False])
            continue
        held = re.fullmatch(f"{HOLD}(\\d+){HOLD}", body)
        whole = held and scan.held[int(held[1])]
        if whole and whole[0] == "plain":
            body, line = whole[1].strip(), whole[1]
        elif held and scan.held[int(held[1])][0] in ("code", "formula"):
            blocks.append([*scan.held[int(held[1])], True])
            continue
        body = re.sub(f"{HOLD}(\\d+){HOLD}", lambda m: {"inline code": "`{}`", "inline formula": "${}$"}.get(scan.held[int(m[1])][0], "{}").format(scan.held[int(m[1])][1]), body)
        role = "heading" if re.match(r"#{1,6} ", body) else "list" if re.match(r"(?:[-*+•]|\d+[.)]) ", body) else "table" if body.startswith("|") else "text"
        touched = line not in original
        if role == "text" and blocks and blocks[-1][0] == "text":
            blocks[-1][1] += f"\n{body}"
            blocks[-1][2] |= touched
        else:
            blocks.append([role, body, touched])
    blocks = [b for b in blocks if b[0]]
    labels = second_pass([first_pass(*b) for b in blocks])
    if "text" not in labels:
        labels = ["text"] * len(blocks)
    out = []
    for (role, body, _), label in zip(blocks, labels, strict=True):
        body = re.sub(r"[ \t]{2,}", " ", body.replace("\ue001", "").replace("\ue002", "")).strip() if role != "code" else body
        out.append((role, label, {"code": f"```\n{body}\n```", "formula": f"$$ {body} $$"}.get(role, body)))
    clean = "\n".join(x for _, label, x in out if label == "text" and x)
    return sorted(scan.kinds), clean, out


def kinds_of(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """`columns` and kinds, an array of the kinds of markup that `text` holds; empty for null. Row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [analyse(t)[0] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kinds, pa.list_(pa.string()))], [*columns, "kinds"])

    read = df.select(*columns, text)
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in columns), "kinds array<string>"]))


def clean(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """`columns` with markup (array<string>), clean (string) and blocks (role, label and text of each). Row-local."""

    @F.pandas_udf("markup array<string>, clean string, blocks array<struct<role:string,label:string,text:string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [analyse(t) for t in texts]
        return pd.DataFrame({"markup": [k for k, _, _ in rows], "clean": [c for _, c, _ in rows], "blocks": [[{"role": r, "label": x, "text": t} for r, x, t in b] for _, _, b in rows]})

    return df.select(*columns, run(F.col(text)).alias("_c")).select(*columns, "_c.markup", "_c.clean", "_c.blocks")
