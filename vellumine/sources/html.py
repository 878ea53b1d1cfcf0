"""HTML pages to content blocks, Markdown and search results.

The standard library's parser builds a small tree per page inside an Arrow function; what follows (padding tables, Markdown
lines, filters, joins) is built in. Lists are kept and inline text stays in document order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions import patterns as P
from vellumine.functions import text as X
from vellumine.operators.chunking import arrow, normalize, with_parts
from vellumine.operators.grammar import space
from vellumine.sources.registry import first_of_equals

# Element and attribute names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOISE = frozenset("script style noscript iframe button svg".split())
KEPT_ATTRIBUTES = frozenset("href src colspan rowspan".split())
CONTAINERS = frozenset("p div section article main center".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img".split())
BLOCK = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("ordered", T.BooleanType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
])


class Node:
    """An element: name, attributes and children, which are nodes or strings."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            elif node.name not in ("script", "style") or node is self:
                todo += reversed(node.children)

    def text(self) -> str:
        return " ".join(s for s in (x.strip() for x in self.strings()) if s)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.name != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def is_legal(text: str) -> bool:
    return len(text) >= 50 and any(m in text for m in P.LEGAL_MARKERS)


#: Where a page's content may be, by precedence.
PLACES = (
    lambda n: n.attrs.get("id") == "toanvan", lambda n: n.attrs.get("id") == "divContentDoc", lambda n: "content1" in n.attrs.get("class", "").split(),
    lambda n: "fulltext" in n.attrs.get("class", "").split(), lambda n: "doc-content" in n.attrs.get("class", "").split(), lambda n: "document-content" in n.attrs.get("class", ""),
    lambda n: "content" in n.attrs.get("class", ""), lambda n: n.name == "article", lambda n: n.name == "main",
)


def content_node(root: Node, legal_only: bool = True) -> Node | None:
    """The page's content: the first known place that reads like a legal text, else the longest container that does.

    Without ``legal_only`` any text counts, and the whole page where there is no container.
    """
    good = (lambda n: is_legal(space(n.text()))) if legal_only else (lambda n: bool(n.text()))
    for place in PLACES:
        node = next((n for n in root.walk() if place(n)), None)
        if node and good(node):
            return node
    rest = [n for n in root.walk() if n.name in ("div", "section", "article", "main") and good(n)]
    return max(rest, key=lambda n: len(n.text())) if rest else None if legal_only else root


def clean(node: Node) -> Node:
    """Without noise elements and all but a few attributes; in place."""
    for n in list(node.walk()):
        n.children = [c for c in n.children if isinstance(c, str) or c.name not in NOISE]
        n.attrs = {k: v for k, v in n.attrs.items() if k in KEPT_ATTRIBUTES}
    return node


def _block(kind: str, text: str | None = None, **more) -> dict:
    return {"type": kind, "level": None, "text": text, "ordered": None, "items": None, "rows": None} | more


def blocks(node: Node) -> list[dict]:
    """Paragraphs, headings, tables and lists below a node, in document order."""
    out: list[dict] = []
    run: list[str] = []

    def flush() -> None:
        text = space(" ".join(x.strip() for x in run if x.strip()))
        run.clear()
        if text:
            out.append(_block("paragraph", text))

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                run.append(c)
            elif c.name in INLINE:
                run.append(c.text())
            elif c.name in NOISE:
                continue
            else:
                flush()
                if c.name in HEADINGS:
                    out.append(_block("heading", c.text(), level=int(c.name[1])))
                elif c.name == "table":
                    rows = [[space(x.text()) for x in _cells(tr)] for tr in _rows(c)]
                    out.append(_block("table", rows=[r for r in rows if r]))
                elif c.name in ("ul", "ol"):
                    items = [space(x.text()) for x in c.children if isinstance(x, Node) and x.name == "li"]
                    out.append(_block("list", ordered=c.name == "ol", items=[x for x in items if x]))
                else:
                    visit(c)
                    flush()

    visit(node)
    flush()
    return [b for b in out if b["text"] or b["rows"] or b["items"]]


def _rows(table: Node) -> list[Node]:
    """The table's own rows, not those of tables inside its cells."""
    out, todo = [], list(table.children)
    while todo:
        n = todo.pop(0)
        if isinstance(n, Node):
            if n.name == "tr":
                out.append(n)
            elif n.name != "table":
                todo = list(n.children) + todo
    return out


def _cells(tr: Node) -> list[Node]:
    return [c for c in tr.children if isinstance(c, Node) and c.name in ("th", "td")]


def page(html: str | None, legal_only: bool) -> dict:
    root = tree(html)
    for n in root.walk():
        n.parent = None  # not asked below; without cycles a tree goes as soon as its page is done
    title = next((n.text() for n in root.walk() if n.name == "title"), "") or next((n.text() for n in root.walk() if n.name == "h1"), "")
    whole = space(root.text())
    node = content_node(root, legal_only)
    if node is None:
        return {"title": space(title), "page_text": whole, "text": "", "blocks": []}
    node = clean(node)
    return {"title": space(title), "page_text": whole, "text": space(node.text()), "blocks": blocks(node)}


PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("page_text", T.StringType()), T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK))])
RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("href", "title", "card_title", "card_text")])
_RESULT_LINK = re.compile(r"vbpq-(?:toanvan|thuoctinh)\.aspx\?ItemID=\d+", re.I)


def result_links(html: str | None) -> list[dict]:
    """Links to documents on a listing page, with their card's heading and text."""
    out = []
    for a in tree(html).walk():
        href = a.attrs.get("href", "")
        if a.name != "a" or not (_RESULT_LINK.search(href) or "/van-ban/" in href):
            continue
        card, node = a.parent if a.parent and a.parent.name else None, a
        for _ in range(5):
            if node is None or not node.name:
                break
            text = node.text()
            if "Trạng thái" in text or any(s in text for s in P.STATUSES):
                card = node
                break
            node = node.parent
        heading = next((n.text() for n in card.walk() if n.name in ("h1", "h2", "h3", "h4")), "") if card else ""
        out.append({"href": href, "title": space(a.text()), "card_title": space(heading), "card_text": space((card or a).text())})
    return out


def has_next(html: str | None, current: int) -> bool:
    root = tree(html)
    for n in root.walk():
        if any(isinstance(c, str) and re.search(r"\bSau\b", c, re.I) for c in n.children):
            return "disabled" not in n.attrs.get("class", "")
    return any(n.name == "a" and n.text().strip() == str(current + 1) for n in root.walk())


def parsed_pages(pages: DataFrame, html: str = "html", legal_only: bool = True) -> DataFrame:
    """``pages`` with ``title``, ``page_text``, ``text`` and ``blocks`` in a struct ``page``."""
    return with_parts(pages, {"page": PAGE}, (html,), lambda text: (page(text, legal_only),))


def search_results(pages: DataFrame, html: str = "html", base: str = "") -> DataFrame:
    """Documents that listing pages link to, once each, with type and status among the allowed."""
    rows = pages.select(F.explode(arrow(T.ArrayType(RESULT))(lambda html: result_links(html))(F.col(html))).alias("r"))
    href = F.when(F.col("r.href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("r.href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(F.col("r.href"), F.lit("/"))))
    title = X.first_of("r.card_title", "r.title", X.infer_title("r.card_text"))
    rows = rows.select(X.detail_url(href).alias("source_url"), title.alias("title"), F.col("r.card_text").alias("card_text")).distinct()
    rows = rows.withColumn("status", X.infer_status("card_text")).withColumn("document_type", X.infer_type(X.first_of("title", "card_text"))).withColumn("metadata", X.metadata_from_text("card_text"))
    rows = rows.filter("title != '' AND status != '' AND document_type != ''").drop("card_text")
    rows = first_of_equals(rows, "source_url")
    return rows.select(X.id_from_url("source_url").alias("document_id"), "*")


def block_markdown(b: Column) -> Column:
    """The Markdown of one block."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rows = X.padded(b["rows"])
    rule = F.array_repeat(F.lit("---"), X.table_width(b["rows"]))
    table = F.array_join(F.concat(F.array(line(F.try_element_at(rows, F.lit(1)))), F.array(line(rule)), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")
    listed = F.array_join(F.transform(b["items"], lambda x, i: F.concat(F.when(b["ordered"], F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x)), "\n")
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(b["level"], F.lit(2)), F.lit(1)), F.lit(6))), F.lit(" "), X.text(b["text"]))
    return F.when(b["type"] == "heading", heading).when(b["type"] == "table", table).when(b["type"] == "list", listed).otherwise(F.trim(X.text(b["text"])))


def blocks_markdown(c: X.Text) -> Column:
    """The Markdown of all blocks, an empty line after each."""
    return F.array_join(F.transform(X.col(c), lambda b: F.concat(block_markdown(b), F.lit("\n"))), "\n")


def markdown_lines(block: dict) -> list[str]:
    """The Markdown lines of one block, as ``block_markdown`` writes them."""
    kind, rows = block["type"], block["rows"] or []
    if kind == "heading":
        return ["#" * min(max(block["level"] or 2, 1), 6) + " " + (block["text"] or "")]
    if kind == "table":
        width = max(map(len, rows))
        full = [r + [""] * (width - len(r)) for r in rows]
        return ["| " + " | ".join(r) + " |" for r in [full[0], ["---"] * width, *full[1:]]]
    if kind == "list":
        return [(f"{i}. " if block["ordered"] else "- ") + x for i, x in enumerate(block["items"], 1)]
    return [(block["text"] or "").strip()]


def page_markdown(found: list[dict] | None, url: str | None, kind: str | None, status: str | None, title: str | None) -> str:
    head = [f"<!-- {n}: {v or ''} -->" for n, v in (("source_url", url), ("document_type", kind), ("status", status))]
    return normalize("\n".join([*head, f"# {title or ''}", "", *(line for b in found or [] for line in [*markdown_lines(b), ""])]))


def document_markdown(blocks_: X.Text, url: X.Text, kind: X.Text, status: X.Text, title: X.Text) -> Column:
    """A document as Markdown: where it comes from, its title and its blocks, with legal headings normalised."""
    f = arrow(T.StringType())(lambda found, url, kind, status, title: page_markdown(found, url, kind, status, title))
    return f(*map(X.col, (blocks_, url, kind, status, title)))
