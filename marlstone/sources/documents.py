"""Readers of files: discovery, DOCX, markup, raw record JSON, spreadsheets; and writers."""

from __future__ import annotations

import fnmatch
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.staging import small_batches

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Tags whose text is no running text.
SKIPPED_TAGS = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
BLOCK_TAGS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "br", "tr", "blockquote", "pre"}


def find_files(spark: SparkSession, root: str, pattern: str = "*.pdf", mains_only: bool = False, most: int | None = None) -> DataFrame:
    """``path, length, content`` of all files below ``root`` that match; with ``mains_only`` those that name a supplement are left out; ``most`` takes the first so many by path.

    ``root`` may be a file itself; one that does not match the pattern is a ValueError. Only paths are sorted, and only
    where ``most`` asks for it; contents are read where they are used.
    """
    name = root.rstrip("/").rsplit("/", 1)[-1]
    if re.fullmatch(r".+\.[A-Za-z0-9]{1,5}", name) and not any(c in name for c in "*?[") and not fnmatch.fnmatch(name.lower(), pattern.lower()):
        raise ValueError(f"{root} is no {pattern}")
    files = spark.read.format("binaryFile")
    found = files.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    found = found.where(~T.is_supplement(F.col("path"))) if mains_only else found
    if most is None:
        return found
    paths = [r["path"] for r in found.select("path").orderBy("path").limit(most).collect()]  # no more than asked for
    return files.load(paths) if paths else found.limit(0)


def markdown_table(rows: list[list[str]]) -> str:
    """Cells as a Markdown table, padded, pipes escaped."""
    width = max(map(len, rows), default=0)
    cells = [[" ".join(c.split()).replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]) if rows else ""


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """(``text`` or ``table``, content) of a DOCX body in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def words(node: ElementTree.Element) -> str:
        return " ".join("".join(t.text or "" for t in node.iter(f"{_W}t")).split())

    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p" and words(node):
            out.append(("text", words(node)))
        elif node.tag == f"{_W}tbl":
            out.append(("table", markdown_table([[words(c) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")])))
    return out


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.skipped = 0
        self.rows: list[list[str]] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text and self.rows is None:
            self.out.append(("text", text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED_TAGS:
            self.skipped += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th"):
            self.text = []
        elif tag in BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED_TAGS:
            self.skipped = max(0, self.skipped - 1)
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(" ".join("".join(self.text).split()))
            self.text = []
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                self.out.append(("table", markdown_table(rows)))
        elif tag in BLOCK_TAGS and self.rows is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append(data)


def markup_blocks(html: str | None, merge_below: int = 200) -> list[tuple[str, str]]:
    """(``text`` or ``table``, content) of a page in document order; a text shorter than ``merge_below`` joins the text after it."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.flush()
    out: list[tuple[str, str]] = []
    for kind, text in parser.out:
        if out and kind == "text" and out[-1][0] == "text" and len(out[-1][1]) < merge_below:
            out[-1] = ("text", f"{out[-1][1]} {text}")
        else:
            out.append((kind, text))
    return out


def chunks(text: str | None, size: int = 1800, least: int = 40) -> list[str]:
    """Sentences packed up to ``size`` characters; a longer sentence stays whole, a chunk under ``least`` goes."""
    out, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9(])", " ".join((text or "").split())):
        if now and len(now) + len(s) + 1 > size:
            out.append(now)
            now = s
        else:
            now = f"{now} {s}".strip()
    return [c for c in [*out, now] if len(c) >= least]


#: Characters of elements that a task holds before it hands them on.
HELD = 1_000_000


def _elements(blocks: Callable, size: int, least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "idx", "type", "content", "error"]).astype({"idx": "int32"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for ident, content in frame.itertuples(index=False, name=None):
                try:
                    found, error = blocks(content), None
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as failed:
                    found, error = [], f"{type(failed).__name__}: {failed}"
                tables = [("table", t) for k, t in found if k == "table"]
                texts = [("text", c) for k, t in found if k == "text" for c in chunks(t, size, least)]
                rows += [(ident, i, k, t, None) for i, (k, t) in enumerate([*tables, *texts], 1)] or [(ident, 0, "error", None, error or "empty")]
                held += sum(len(t) for _, t in found)
                if held >= HELD:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    return run


def elements(df: DataFrame, ident: str, content: str, kind: str = "html", size: int = 1800, least: int = 40) -> DataFrame:
    """Ordered elements of each document (tables first, then text chunks of ``least`` characters or more): ``id, idx, type, content, error``.

    A document that cannot be read, or is empty, has one row of type ``error``.
    """
    small_batches(df.sparkSession)
    blocks = {"html": markup_blocks, "docx": lambda c: docx_blocks(bytes(c))}[kind]
    return df.select(ident, content).mapInPandas(_elements(blocks, size, least), f"id {dict(df.dtypes)[ident]}, idx int, type string, content string, error string")


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw records from JSON files, either lists of ``{key, row}`` or objects of lists by key: ``key, row`` (a map), ``file``."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    listed = F.from_json("value", "array<struct<key string, row map<string, string>>>")
    keyed = F.from_json("value", "map<string, array<map<string, string>>>")
    a = whole.where(F.trim("value").startswith("[")).select("file", F.inline(listed))
    b = whole.where(F.trim("value").startswith("{")).select("file", F.explode(keyed).alias("key", "rows")).select("file", "key", F.explode("rows").alias("row"))
    return a.unionByName(b)


def sheet_rows(content: bytes) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells as text) of an XLSX file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        out = []
        for k, name in enumerate(names, 1):
            for n, row in enumerate(ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_S}row")):
                cells: list[str | None] = []
                for c in row.iter(f"{_S}c"):
                    letters = re.match("[A-Z]+", c.get("r", "")) or None
                    at = len(cells)
                    if letters:
                        at = 0
                        for x in letters.group(0):
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    v, inline = c.find(f"{_S}v"), "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    value = inline or None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = value
                out.append((name, n, cells))
    return out


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all sheets of the XLSX files below a path: ``path, sheet, row, cells``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *r) for p, c in f.itertuples(index=False, name=None) for r in sheet_rows(c)], columns=["path", "sheet", "row", "cells"]).astype({"row": "int32"})

    return find_files(spark, path, "*.xlsx").select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def unique_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """``target``: the name, or for later files of one name the stem, ``__n`` and the extension."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.[^.]*$", 0)
    return files.withColumn("target", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("__"), n, ext)))


#: Names under which a list of articles may have its columns.
ARTICLE_COLUMNS = {"doi": ["doi"], "link": ["doi link", "doi_link", "url", "link"], "title": ["filename", "article title", "title"]}


def first_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of the names that a column has, blanks, underscores and case aside."""
    folded = {re.sub(r"[\s_]+", "", c.strip().lower()): c for c in reversed(df.columns)}
    return next((folded[re.sub(r"[\s_]+", "", n.lower())] for n in names if re.sub(r"[\s_]+", "", n.lower()) in folded), None)


def article_list(sheet: DataFrame, order: str) -> DataFrame:
    """``order, doi, link, title`` of a list of articles: rows with a DOI or a link, the first of each DOI or else link. Missing columns are null."""
    found = {k: first_column(sheet, names) for k, names in ARTICLE_COLUMNS.items()}
    columns = {k: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string") for k, c in found.items()}
    rows = sheet.select(order, T.find_doi(columns["doi"]).alias("doi"), T.blank_to_null(columns["link"]).alias("link"), T.blank_to_null(columns["title"]).alias("title"))
    rows = rows.where("doi is not null or link is not null").withColumn("_k", F.coalesce("doi", "link"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(order))).where("_n = 1").drop("_n", "_k")


def extract_texts(files: DataFrame, parser: Callable[[bytes, int], tuple[list[str], int]], most_pages: int = 20, between: str = "\n") -> DataFrame:
    """``path, text, pages, error`` of binary files (``path, content``) by a page parser: (content, most pages) -> (texts of the first pages, all pages).

    The parser is given, so no library for a format is needed here; a file that it fails on has an ``error``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in frame.itertuples(index=False, name=None):
                try:
                    texts, pages = parser(bytes(content), most_pages)
                    rows.append((path, between.join(texts[:most_pages]), pages, None))
                except Exception as failed:  # a parser may fail in any way
                    rows.append((path, None, 0, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "error"]).astype({"pages": "int32"})

    return files.select("path", "content").mapInPandas(run, "path string, text string, pages int, error string")


def leading_share(text: Column, pages: Column, most_pages: int, least: int = 1000) -> Column:
    """A whole text cut to the share that ``most_pages`` are of its pages, ``least`` characters at least."""
    keep = F.greatest(F.floor(F.length(text) * (F.lit(float(most_pages)) / pages)).cast("int"), F.lit(least))
    return F.when(pages > most_pages, F.substring(text, F.lit(1), keep)).otherwise(text)


def flat_records(value: object) -> list[dict]:
    """The records of nested lists, in order; texts are passed over, anything else is a TypeError."""
    if isinstance(value, dict):
        return [value]
    if isinstance(value, str):
        return []
    if isinstance(value, list | tuple):
        return [r for inner in value for r in flat_records(inner)]
    raise TypeError(f"no record: {type(value).__name__}")


def export(df: DataFrame, path: str, kind: str = "parquet", mark: bool = False) -> None:
    """Write a table: Parquet, JSON lines, or CSV with a header in which null is an empty cell; with ``mark`` each CSV file begins with the UTF-8 byte order mark."""
    if kind == "csv":
        # the mark stands before the first name of the header, with which every file begins
        marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
        marked.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)
