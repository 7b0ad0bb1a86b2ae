"""HTML to text blocks and tables. The parser is the standard library's; everything after the blocks is native.

Tree rules: an end tag closes its nearest open namesake and all inside it; a start tag closes nothing; void tags have no
content. Blocks are p, h1, h2, h3 and div in document order; a div that holds another block (h4 counts) is left out, a p
inside a p is a block of its own besides. Text inside style, script and table is never part of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.text import squeeze

BLOCKS = ("p", "h1", "h2", "h3", "div")
_HOLDERS = {*BLOCKS, "h4"}
_HIDDEN = {"style", "script", "table", "meta", "link"}
#: Nesting beyond which blocks inside blocks don't repeat their text: times the page's text, and characters at least.
NESTED, NESTED_LEAST = 20, 1_000_000
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

BLOCK_TYPE = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType()), T.StructField("bold", T.BooleanType())]))
TABLE_TYPE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("rows", T.ArrayType(T.MapType(T.StringType(), T.StringType())))]))


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _walk(node: _Node, hidden: set[str] | frozenset = frozenset()) -> Iterator[_Node | str]:
    """Everything below the node in document order, without what is inside hidden tags."""
    todo = [iter(node.children)]
    while todo:
        for child in todo[-1]:
            if isinstance(child, str):
                yield child
            elif child.tag not in hidden:
                yield child
                todo.append(iter(child.children))
                break
        else:
            todo.pop()


def _text(node: _Node, hidden: set[str] | frozenset = frozenset()) -> str:
    parts = (x.strip() for x in _walk(node, hidden) if isinstance(x, str))
    return " ".join(" ".join(p for p in parts if p).split())


def blocks(root: _Node) -> list[tuple[str, str, bool]]:
    """(tag, text, bold) of the blocks that have text. One pass over the page: texts go into one list, of which a block keeps its stretch; what is inside a block is settled as it closes.

    Blocks inside blocks each repeat their text (a p that isn't closed holds the next one). Where that alone would make a page's blocks longer than NESTED times its text and NESTED_LEAST characters, blocks in which another block begins give only what stands before it, so the result stays in proportion to the page."""
    pieces: list[str] = []
    found: list[list] = []
    todo: list[tuple[_Node, Iterator, list | None]] = [(root, iter(root.children), None)]
    above: list[list] = []
    while todo:
        node, rest, mine = todo[-1]
        for child in rest:
            if isinstance(child, str):
                words = child.split()
                if words:
                    pieces.append(" ".join(words))
            elif child.tag not in _HIDDEN:
                if above:
                    # a tag inside counts for all blocks around it: noted at the nearest, handed on as that closes
                    above[-1][3] |= child.tag in _HOLDERS
                    above[-1][4] |= child.tag in ("b", "strong")
                block = None
                if child.tag in BLOCKS:
                    if above and above[-1][5] < 0:
                        above[-1][5] = len(pieces)
                    block = [child.tag, len(pieces), 0, False, False, -1]
                    found.append(block)
                    above.append(block)
                todo.append((child, iter(child.children), block))
                break
        else:
            todo.pop()
            if mine is not None:
                mine[2] = len(pieces)
                above.pop()
                if above:
                    above[-1][3] |= mine[3]
                    above[-1][4] |= mine[4]
    lengths = [0]
    for x in pieces:
        lengths.append(lengths[-1] + len(x) + 1)
    kept = [f for f in found if not (f[0] == "div" and f[3])]
    whole = sum(lengths[f[2]] - lengths[f[1]] for f in kept) <= max(NESTED * lengths[-1], NESTED_LEAST)
    out = []
    for tag, begin, end, _, bold, inner in kept:
        if end > begin:
            text = " ".join(pieces[begin : end if whole or inner < 0 else max(inner, begin)])
            if text:
                out.append((tag, text, bold))
    return out


def _cells(row: _Node) -> list[tuple[str, str | None, int, int]]:
    def span(node: _Node, name: str) -> int:
        value = node.attrs.get(name) or ""
        return max(1, min(int(value), 1000)) if value.isdigit() else 1

    return [(c.tag, _text(c) or None, span(c, "colspan"), span(c, "rowspan")) for c in row.children if isinstance(c, _Node) and c.tag in ("td", "th")]


def tables(root: _Node) -> list[tuple[str, list[dict[str, str]]]]:
    """(table_i, records) of tables that hold anything; i counts all. Rows of header cells at the top name the columns, else their numbers do; rows and columns without any value are left out."""
    out = []
    for i, table in enumerate((n for n in _walk(root) if isinstance(n, _Node) and n.tag == "table"), 1):
        grid: list[dict[int, str | None]] = []
        heads: list[bool] = []
        below: dict[int, tuple[int, str | None]] = {}
        for row in (n for n in _walk(table, {"table"}) if isinstance(n, _Node) and n.tag == "tr"):
            line: dict[int, str | None] = {}
            at, cells = 0, _cells(row)
            kept = {c: (k - 1, v) for c, (k, v) in below.items() if k > 1}
            line.update({c: v for c, (_, v) in below.items()})
            for _, value, width, height in cells:
                for _ in range(width):
                    while at in line:
                        at += 1
                    line[at] = value
                    if height > 1:
                        kept[at] = (height, value)
                    at += 1
            below = {c: (k, v) for c, (k, v) in kept.items()}
            grid.append(line)
            heads.append(bool(cells) and all(tag == "th" for tag, *_ in cells))
        n_heads = 0
        while n_heads < len(heads) and heads[n_heads]:
            n_heads += 1
        body = [g for g in grid[n_heads:] if any(v is not None for v in g.values())]
        columns = sorted({c for g in body for c, v in g.items() if v is not None})
        names = {c: " ".join(dict.fromkeys(g[c] for g in grid[:n_heads] if g.get(c))) or str(c) for c in columns}
        if body:
            out.append((f"table_{i}", [{names[c]: g.get(c) for c in columns} for g in body]))
    return out


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df's other columns with blocks, tables and error: a document that can't be read gives its error and empty lists, and never stops the run. Binary html is read as UTF-8 without what isn't."""
    keep = [f for f in df.schema if f.name not in (html, "blocks", "tables", "error")]
    schema = T.StructType([*keep, T.StructField("blocks", BLOCK_TYPE), T.StructField("tables", TABLE_TYPE), T.StructField("error", T.StringType())])

    def one(page: str | bytes | None) -> tuple:
        try:
            root = parse(page.decode(errors="ignore") if isinstance(page, bytes | bytearray) else page or "")
            return [{"tag": t, "text": x, "bold": b} for t, x, b in blocks(root)], [{"name": n, "rows": r} for n, r in tables(root)], None
        except Exception as e:  # noqa: BLE001  a bad document is data
            return [], [], f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(page) for page in batch[html]]
            out = batch[[f.name for f in keep]].copy()
            for i, name in enumerate(("blocks", "tables", "error")):
                out[name] = pd.Series([f[i] for f in found], index=out.index, dtype=object)
            yield out

    return df.select(*[f.name for f in keep], html).mapInPandas(run, schema)


def markdown_line(text: Column, bold: Column) -> Column:
    """A block's line: headings by capitals and bold type, numbered paragraphs with a bold number, else the text."""
    capitals = (F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) > 4)
    n = F.length(text)
    heading1, heading2 = capitals & bold & (n < 100), (bold | capitals) & (n < 150)
    numbered = F.regexp_replace(text, r"(?U)^(\d+\.)\s*([^\n]*)", "**$1** $2")
    return F.when(heading1, F.concat(F.lit("\n# "), text, F.lit("\n"))).when(heading2, F.concat(F.lit("\n## "), text, F.lit("\n"))).otherwise(numbered)


def markdown(blocks_column: Column | str) -> Column:
    """The document as markdown."""
    c = F.col(blocks_column) if isinstance(blocks_column, str) else blocks_column
    return F.array_join(F.transform(c, lambda b: markdown_line(squeeze(b["text"]), b["bold"])), "\n")
