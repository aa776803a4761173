"""Parsers by contract: which extensions and source types they take, and which one a file goes to.

The registry lives on the driver. Parsers reach workers in the closure of the query that uses them.
"""

from __future__ import annotations

import importlib
import re
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.types import FAMILIES

SOURCE_TYPE = re.compile(r"[a-z][a-z0-9_]{0,31}\Z")


class RegistrationError(ValueError):
    """A parser's contract is invalid or at odds with one registered before."""


@dataclass(frozen=True)
class Capability:
    name: str
    version: str
    extensions: tuple[str, ...]
    priority: int
    source_types: tuple[str, ...]
    family: str
    parse: Callable = field(compare=False, default=None)
    origin: str = "built-in"


def checked(c: Capability) -> Capability:
    """The capability, if its contract is valid."""

    def claim(ok: bool, what: str) -> None:
        if not ok:
            raise RegistrationError(f"{c.name!r}: {what}")

    claim(bool(c.name) and isinstance(c.name, str), "a name is needed")
    claim(bool(c.version) and isinstance(c.version, str), "a version is needed")
    claim(isinstance(c.priority, int) and not isinstance(c.priority, bool) and c.priority >= 1, "priority must be an integer from 1")
    claim(bool(c.extensions) and all(len(e) >= 2 and e.startswith(".") and e == e.lower() for e in c.extensions), "extensions must be lower case with a dot")
    claim(bool(c.source_types) and all(SOURCE_TYPE.match(s) for s in c.source_types), "source types must match [a-z][a-z0-9_]{0,31}")
    claim(c.family in set(FAMILIES.values()), "unknown locator family")
    return c


class Registry:
    """Capabilities in order of registration."""

    def __init__(self):
        self.parsers: dict[str, Capability] = {}
        self.families: dict[str, str] = {}
        self.loaded: set[str] = set()
        self._origin = "built-in"

    def register(self, capability: Capability) -> Capability:
        """Adds a parser. Names are unique, and a source type keeps the family of the first parser that took it."""
        c = checked(capability)
        if c.name in self.parsers:
            raise RegistrationError(f"{c.name!r} is registered already")
        for s in c.source_types:
            if self.families.get(s, c.family) != c.family:
                raise RegistrationError(f"{s!r} is bound to {self.families[s]!r}")
        c = Capability(**{**c.__dict__, "origin": self._origin})
        self.parsers[c.name] = c
        self.families.update(dict.fromkeys(c.source_types, c.family))
        return c

    def candidates(self, extension: str) -> list[Capability]:
        """Those that take an extension, by priority, then by registration."""
        return sorted((c for c in self.parsers.values() if extension.lower() in c.extensions), key=lambda c: c.priority)

    def discover(self, extension: str) -> Capability:
        """The first candidate; a tie warns, none is an error."""
        found = self.candidates(extension)
        if not found:
            raise ValueError(f"no parser takes {extension!r}")
        if len(found) > 1 and found[0].priority == found[1].priority:
            warnings.warn(f"{found[0].name} and {found[1].name} both take {extension} at priority {found[0].priority}", stacklevel=2)
        return found[0]

    def get(self, name: str) -> Capability:
        if name not in self.parsers:
            raise ValueError(f"unknown parser {name!r}")
        return self.parsers[name]

    def listing(self) -> list[dict]:
        """What each parser declares, by priority and name."""
        return [self.inspect(c.name) for c in sorted(self.parsers.values(), key=lambda c: (c.priority, c.name))]

    def inspect(self, name: str) -> dict:
        c = self.get(name)
        return {"name": c.name, "priority": c.priority, "extensions": list(c.extensions), "version": c.version, "source_types": list(c.source_types), "locator_family": c.family}

    def explain(self, extension: str) -> dict:
        """Why a parser takes an extension: the candidates in order, the winner, the reason, and who ties with it."""
        found = self.candidates(extension)
        tied = [c.name for c in found if c.priority == found[0].priority]
        reason = "no_candidates" if not found else "single_candidate" if len(found) == 1 else "registration_order" if len(tied) > 1 else "priority"
        return {"extension": extension, "candidates": [{"name": c.name, "priority": c.priority} for c in found], "winner": found[0].name if found else None, "reason": reason, "tied_names": tied if len(tied) > 1 else []}

    def load(self, modules: Iterable[str]) -> None:
        """Imports plugin modules, each once; a module's `register_parsers(registry)` adds its parsers."""
        for module in modules:
            if module in self.loaded:
                continue
            try:
                plugin = importlib.import_module(module)
            except Exception as e:
                raise RegistrationError(f"plugin_import_failed: {module}: {e}") from e
            self._origin = module
            try:
                plugin.register_parsers(self)
            except Exception as e:
                raise RegistrationError(f"plugin_register_failed: {module}: {e}") from e
            finally:
                self._origin = "built-in"
            self.loaded.add(module)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, version, extension, priority, order, source_types, family, origin): one row for each parser and extension."""
        rows = [(c.name, c.version, e, c.priority, n, list(c.source_types), c.family, c.origin) for n, c in enumerate(self.parsers.values()) for e in c.extensions]
        return spark.createDataFrame(rows, "name string, version string, extension string, priority int, `order` int, source_types array<string>, family string, origin string")

    def audit(self, spark: SparkSession) -> DataFrame:
        """(extension, parsers, first, contested): who takes each extension."""
        best = F.min_by("name", F.struct("priority", "order"))
        by = self.table(spark).groupBy("extension").agg(F.count("*").alias("parsers"), best.alias("first"), F.min("priority").alias("p"), F.collect_list("priority").alias("all"))
        return by.select("extension", "parsers", "first", (F.size(F.filter("all", lambda x: x == F.col("p"))) > 1).alias("contested"))

    def route(self, path: Column | str, requested: str = "auto") -> Column:
        """The parser that each path goes to: the one asked for, but Markdown for .md where that is `fallback`; for `auto` the
        first candidate, `fallback` where there is none."""
        extension = T.extension(path)
        if requested != "auto":
            self.get(requested)
            return F.when((F.lit(requested) == "fallback") & (extension == ".md"), "markdown").otherwise(requested)
        taken = sorted({e for c in self.parsers.values() for e in c.extensions})
        first = F.create_map([F.lit(x) for e in taken for x in (e, self.candidates(e)[0].name)])
        return F.coalesce(first[extension], F.lit("fallback"))


def built_in() -> Registry:
    """The parsers of this package, in their order and with their priorities."""
    from docspark.parsers import docx, extracted, html, markdown, notebook, pages

    r = Registry()
    office = lambda data, i: docx.parse(data, i) if data[:2] == b"PK" else pages.parse(data, i)
    r.register(Capability("fallback", "1", (".pdf", ".docx"), 10, ("docx",), "structural_index", office))
    r.families["pdf"] = "page_geometry"
    r.register(Capability("kreuzberg", "1", (".pdf", ".docx"), 50, ("docx",), "structural_index", extracted.parse))
    r.register(Capability("markdown", "1", (".md", ".markdown"), 20, ("markdown",), "line_address", markdown.parse))
    r.register(Capability("html", "1", (".html", ".htm"), 100, ("html",), "line_address", html.parse))
    r.register(Capability("text", "1", (".txt", ".text"), 100, ("text",), "line_address"))
    r.register(Capability("ipynb", "1", (".ipynb",), 100, ("ipynb",), "container_line", notebook.parse))
    r.register(Capability("markdown_enhanced", "1", (".md", ".markdown"), 5, ("markdown",), "line_address", markdown.parse_enhanced))
    return r
