"""Articles in the markup of five publishers: ordered elements and metadata, by one reader and a table of dialects."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never have an end tag.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element: its name, attributes, parent and children (elements and texts)."""

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []

    def walk(self) -> Iterator[Node]:
        """This element's descendants in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, without: frozenset[str] | set[str] = frozenset()) -> str:
        """All text inside, that of the elements named in ``without`` left out."""
        out, stack = [], [*reversed(self.children)]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.name not in without:
                stack += reversed(c.children)
        return "".join(out)

    def first(self, *names: str, **attributes: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names and all(n.attributes.get(k.replace("_", "-")) == v for k, v in attributes.items())), None)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def read_markup(markup: str) -> Node:
    """The element tree of tolerant markup; names are lower case, an end tag without a start is passed over."""
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    return reader.root


def _classes(node: Node) -> str:
    return node.attributes.get("class", "")


@dataclass(frozen=True)
class Dialect:
    """Which elements are paragraphs, tables and figures; parents under which a paragraph is none; elements taken out of it."""

    text: frozenset[str]
    table: frozenset[str]
    figure: frozenset[str]
    no_text_under: frozenset[str]
    taken_out: frozenset[str]
    missing: str | None
    metadata: Callable[[Node, str | None], dict]
    is_text: Callable[[Node], bool] = field(default=lambda node: True)
    is_figure: Callable[[Node], bool] = field(default=lambda node: True)
    is_table: Callable[[Node], bool] = field(default=lambda node: True)
    merge_below: int = 200
    keep_empty: bool = True


def _text_of(node: Node | None, missing: str | None) -> str | None:
    return missing if node is None else node.text().strip()


def _month(node: Node | None, missing: str | None, default: str | None = None) -> str | None:
    """``year.month`` of a date element; without a month the default, or nothing."""
    year, month = (node.first("year"), node.first("month")) if node is not None else (None, None)
    if year is None or (month is None and default is None):
        return missing
    return f"{year.text().strip()}.{month.text().strip().zfill(2) if month is not None else default}"


def _journal_article(title: str, journal: str, date: Callable[[Node], Node | None], default: str | None = None, authors_only: bool = False) -> Callable[[Node, str | None], dict]:
    def read(root: Node, missing: str | None) -> dict:
        people = [c for c in root.walk() if c.name == "contrib" and (not authors_only or c.attributes.get("contrib-type") == "author")]
        names = [c.first("name") for c in people]
        return {
            "doi": _text_of(root.first("article-id", pub_id_type="doi"), missing), "title": _text_of(root.first(title), missing), "journal": _text_of(root.first(journal), missing),
            "date": _month(date(root), missing, default), "authors": [n.text().strip() for n in names if n is not None],
        }

    return read


def _core_metadata(root: Node, missing: str | None) -> dict:
    doi, date = root.first("dc:identifier"), root.first("prism:coverdate")
    return {
        "doi": missing if doi is None else doi.text().replace("doi:", "").strip(), "title": _text_of(root.first("dc:title"), missing), "journal": _text_of(root.first("prism:publisher"), missing),
        "date": missing if date is None else ".".join(date.text().strip().split("-")[:-1]), "authors": [n.text().strip() for n in root.walk() if n.name == "dc:creator"],
    }


def _head_metadata(root: Node, missing: str | None) -> dict:
    names = {"doi": ("doi", "Identifier"), "title": ("title", "Title"), "journal": ("journal_title",), "date": ("publication_date", "Date", "date")}
    out: dict = dict.fromkeys(names, missing) | {"authors": []}
    for node in root.walk():
        name = node.attributes.get("name", "")
        if node.name != "meta" or name == "citation_reference" or not ("citation_" in name or "dc." in name):
            continue
        short, content = name.replace("citation_", "").replace("dc.", ""), node.attributes.get("content", "")
        if short in ("author", "Creator"):
            out["authors"].append(content)
        out |= {k: content for k, v in names.items() if short in v}
    lacking = [k for k in names if out[k] is None]
    if lacking:
        raise ValueError(f"metadata without {', '.join(lacking)}")
    return out


def _head_paragraph(node: Node) -> bool:
    classes = _classes(node).split()
    if {"sup_ref", "bold", "ref", "sub_ref", "italic", "small_caps"}.intersection(classes):
        return False
    if "id" in node.attributes:
        return re.search(r"(^|\s)fn", node.attributes["id"]) is not None
    return not any(w in _classes(node) for w in ("btnContainer", "italic", "header_text", "graphic_title"))


def _set(*names: str) -> frozenset[str]:
    return frozenset(names)


#: Element names and rules of the five dialects.
DIALECTS: dict[str, Dialect] = {
    "elsevier": Dialect(
        _set("ce:para", "ce:section-title", "ce:simple-para"), _set("ce:table"), _set("ce:figure"),
        _set("ce:acknowledgement", "ce:acknowledgment", "ce:legend", "ce:bibliography", "ce:keywords", "ce:caption"), _set("ce:cross-refs", "ce:cross-ref"), "", _core_metadata,
    ),
    "acs": Dialect(
        _set("p", "title"), _set("table-wrap"), _set("fig"), _set("caption", "table-wrap-foot", "ack", "fn"), _set("xref", "named-content", "fig", "table-wrap"), None,
        _journal_article("title-group", "publisher-name", lambda r: r.first("pub-date", "date")), is_text=lambda n: "content-type" not in n.attributes,
    ),
    "rsc": Dialect(
        _set("p", "span"), _set("table"), _set("div"), _set(), _set("a"), None, _head_metadata, is_text=_head_paragraph,
        is_figure=lambda n: "image_table" in _classes(n), is_table=lambda n: "class" in n.attributes, keep_empty=False,
    ),
    "springer": Dialect(
        _set("p", "title"), _set("table-wrap"), _set("fig"), _set("notes", "td", "caption", "fig", "th", "table-wrap-foot", "ack", "kwd-group", "ref-list"), _set("fig", "table-wrap"), "",
        _journal_article("title-group", "publisher-name", lambda r: r.first("pub-date", "date")), is_text=lambda n: not n.text().startswith("!ENTITY"),
    ),
    "mdpi": Dialect(
        _set("p", "title"), _set("table-wrap"), _set("fig"), _set("caption", "table-wrap-foot", "ack", "fn", "ref-list", "kwd-group"), _set("xref", "named-content", "fig", "table-wrap"), None,
        _journal_article("article-title", "journal-title", lambda r: r.first("pub-date", pub_type="epub") or r.first("pub-date"), "01", True), merge_below=0, keep_empty=False,
    ),
}


def _clean(text: str) -> str:
    return " ".join(text.split())


def article_elements(markup: str, dialect: Dialect) -> list[tuple[str, str]]:
    """(``text``, ``table`` or ``figure``; content) in document order; a text shorter than ``merge_below`` is put before the text after it."""
    out: list[tuple[str, str]] = []
    open_text = None
    for node in read_markup(markup).walk():
        parent = node.parent.name if node.parent is not None else ""
        if node.name in dialect.table and dialect.is_table(node):
            out.append(("table", _clean(node.text())))
        elif node.name in dialect.figure and dialect.is_figure(node):
            out.append(("figure", _clean(node.text())))
        elif node.name in dialect.text and parent not in dialect.no_text_under and dialect.is_text(node):
            text = _clean(node.text(dialect.taken_out))
            if not text and not dialect.keep_empty:
                continue
            if open_text is not None:
                out[open_text] = ("text", f"{out[open_text][1]}\n\n{text}".strip())
                open_text = None
                continue
            out.append(("text", text))
            if len(text) < dialect.merge_below:
                open_text = len(out) - 1
    return out


def _dialect(publisher: str) -> Dialect:
    if publisher not in DIALECTS:
        raise ValueError(f"no reader for {publisher!r}: one of {', '.join(sorted(DIALECTS))}")
    return DIALECTS[publisher]


def articles(df: DataFrame, ident: str, markup: str, publisher: str) -> DataFrame:
    """Elements of each article: ``id, idx, type, content, error``; numbered from 1. An unreadable one has a row of type ``error``; an unknown publisher is a ValueError."""
    dialect = _dialect(publisher)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, text in frame.itertuples(index=False, name=None):
                found = article_elements(text or "", dialect)
                rows += [(i, k, kind, content, None) for k, (kind, content) in enumerate(found, 1)] or [(i, 0, "error", None, "empty")]
            yield pd.DataFrame(rows, columns=["id", "idx", "type", "content", "error"]).astype({"idx": "int32"})

    return df.select(ident, markup).mapInPandas(run, f"id {dict(df.dtypes)[ident]}, idx int, type string, content string, error string")


def metadata(df: DataFrame, ident: str, markup: str, publisher: str) -> DataFrame:
    """``id, doi, title, journal, date, authors, error`` of each article. What is missing is null or empty, as the publisher's readers have it; where all must be there, the row has an error."""
    dialect = _dialect(publisher)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, text in frame.itertuples(index=False, name=None):
                try:
                    found = dialect.metadata(read_markup(text or ""), dialect.missing)
                    rows.append((i, found["doi"], found["title"], found["journal"], found["date"], found["authors"], None))
                except ValueError as failed:
                    rows.append((i, None, None, None, None, None, str(failed)))
            yield pd.DataFrame(rows, columns=["id", "doi", "title", "journal", "date", "authors", "error"])

    return df.select(ident, markup).mapInPandas(run, f"id {dict(df.dtypes)[ident]}, doi string, title string, journal string, date string, authors array<string>, error string")


def known_publishers(df: DataFrame, column: str) -> DataFrame:
    """Rows whose publisher has a reader, and a flag ``readable`` on all."""
    return df.withColumn("readable", F.lower(column).isin(sorted(DIALECTS)))
