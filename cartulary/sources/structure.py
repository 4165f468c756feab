"""The parsed structure of documents: a tree of headings, lists and tables, as rows.

Each node has a number in the order of the document, its parent's number, its kind, its level, its own text and the headings that
it stands under.  Texts of pages, as loaders make them, are Markdown; web pages are HTML.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "node int, parent int, kind string, level int, text string, section array<string>"
KINDS = ("heading", "paragraph", "list", "item", "table", "row", "cell", "text")
SPACE = re.compile(r"\s+")
#: Nodes that a worker hands on together, about.
AT_ONCE = 10_000


class Tree:
    """Nodes in order; headings hold what follows them up to one of their level or above."""

    def __init__(self):
        self.nodes: list[dict] = []
        self.headings: list[tuple[int, int, str]] = []  # level, node, text
        self.open: list[tuple[str, int]] = []  # lists, tables and rows around

    def add(self, kind: str, text: str = "", level: int = 0) -> int:
        if kind == "heading":
            while self.headings and self.headings[-1][0] >= level:
                self.headings.pop()
        parent = self.open[-1][1] if self.open and kind != "heading" else self.headings[-1][1] if self.headings else None
        self.nodes.append({"node": len(self.nodes), "parent": parent, "kind": kind, "level": level or len(self.open) + 1, "text": text, "section": [t for _, _, t in self.headings]})
        if kind == "heading":
            self.headings.append((level, len(self.nodes) - 1, text))
        return len(self.nodes) - 1

    def begin(self, kind: str) -> None:
        self.open.append((kind, self.add(kind)))

    def end(self, kind: str) -> None:
        """Close the innermost open node of a kind and what is open in it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == kind:
                del self.open[i:]
                return


class _Html(HTMLParser):
    HEADINGS = {f"h{i}": i for i in range(1, 7)}
    GROUPS = {"ul": "list", "ol": "list", "table": "table", "tr": "row"}
    LEAVES = {"p": "paragraph", "li": "item", "td": "cell", "th": "cell", "dt": "item", "dd": "item"}
    BLOCKS = frozenset("article aside blockquote body div dl footer form header html main nav pre section tbody thead tfoot figure figcaption address hr".split())
    SILENT = frozenset("script style template noscript title".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree, self.words, self.kind, self.muted = Tree(), [], ("text", 0), 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.words)).strip()
        self.words = []
        if text:
            self.tree.add(self.kind[0], text, self.kind[1])

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.muted += 1
        elif tag in self.HEADINGS or tag in self.GROUPS or tag in self.LEAVES or tag in self.BLOCKS:
            self.flush()
            self.kind = ("heading", self.HEADINGS[tag]) if tag in self.HEADINGS else (self.LEAVES.get(tag, "text"), 0)
            if tag in self.GROUPS:
                self.tree.begin(self.GROUPS[tag])
        elif tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.muted = max(0, self.muted - 1)
        elif tag in self.HEADINGS or tag in self.GROUPS or tag in self.LEAVES or tag in self.BLOCKS:
            self.flush()
            self.kind = ("text", 0)
            if tag in self.GROUPS:
                self.tree.end(self.GROUPS[tag])

    def handle_data(self, data):
        if not self.muted:
            self.words.append(data)


def html_nodes(page: str) -> list[dict]:
    parser = _Html()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.tree.nodes


_HEADING, _ITEM, _ROW, _RULE = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"\s*(?:[-*+]|[0-9]+[.)])\s+(.*)$"), re.compile(r"\s*\|(.*)\|\s*$"), re.compile(r"\s*\|?[\s:\-|]+\|[\s:\-|]*$")


def markdown_nodes(text: str) -> list[dict]:
    tree, lines = Tree(), []

    def flush() -> None:
        body = SPACE.sub(" ", " ".join(lines)).strip()
        lines.clear()
        if body:
            tree.add("paragraph", body)

    def leave(*but: str) -> None:
        flush()
        for kind in ("list", "table"):
            if kind not in but:
                tree.end(kind)

    for line in text.split("\n"):
        if found := _HEADING.match(line):
            leave()
            tree.add("heading", found[2], len(found[1]))
        elif found := _ITEM.match(line):
            leave("list")
            if not any(k == "list" for k, _ in tree.open):
                tree.begin("list")
            tree.add("item", found[1].strip())
        elif found := _ROW.match(line):
            leave("table")
            if _RULE.match(line):
                continue
            if not any(k == "table" for k, _ in tree.open):
                tree.begin("table")
            tree.begin("row")
            for cell in found[1].split("|"):
                tree.add("cell", cell.strip())
            tree.end("row")
        elif line.strip():
            if tree.open:
                leave()
            lines.append(line.strip())
        else:
            leave()
    flush()
    return tree.nodes


FORMS = {"html": html_nodes, "markdown": markdown_nodes}


def nodes(df: DataFrame, key: str, text: str = "content", form: str = "markdown") -> DataFrame:
    """(key, node, parent, kind, level, text, section): a row for each node of each document; null and empty texts have none.

    A document's tree is made in one pass of its text; documents are as many tasks' as they are dealt to.
    """
    parse = FORMS[form]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "node", "parent", "kind", "level", "text", "section"]
        for batch in batches:
            rows: list[tuple] = []
            for k, body in zip(batch["key"], batch["text"], strict=True):
                rows += [(k, n["node"], n["parent"], n["kind"], n["level"], n["text"], n["section"]) for n in parse(body or "")]
                if len(rows) >= AT_ONCE:
                    yield pd.DataFrame(rows, columns=names).astype({"parent": "Int64"})
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"parent": "Int64"})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").mapInPandas(run, f"key {kind}, {NODES}").withColumnRenamed("key", key)


def outline(df: DataFrame, key: str, text: str = "content", form: str = "markdown") -> DataFrame:
    """(key, structure): each document's tree as one JSON array, as it is written beside a result for inspection."""
    one = F.struct("node", "parent", "kind", "level", "text", "section")
    return nodes(df, key, text, form).groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(one))).alias("structure"))
