"""Text out of HTML, TEI, wikitext and Markdown."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HIDDEN = ("script", "style", "head", "noscript", "template")
BLOCKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "ul", "ol", "table")


def tagless(page: Column) -> Column:
    """Visible text of simple pages without leaving the JVM: hidden elements and tags out, five entities decoded, spaces collapsed."""
    text = F.regexp_replace(page, "(?is)<(script|style|head)\\b.*?</(script|style|head)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in HIDDEN
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def visible_text(page: str | None) -> str:
    """What a reader sees of a page, a line for each block."""
    parser = _Visible()
    parser.feed(page or "")
    parser.close()
    return "\n".join(line for line in (" ".join(x.split()) for x in "".join(parser.parts).split("\n")) if line)


@F.pandas_udf(StringType())
def visible_text_column(pages: pd.Series) -> pd.Series:
    return pages.map(visible_text)


def segments(page: Column, marker: str) -> Column:
    """A page cut where a marker pattern starts: an array of (reference, body)."""
    pieces = F.filter(F.split(page, f"(?={marker})"), lambda x: x.rlike(f"^(?:{marker})"))
    return F.transform(pieces, lambda x: F.struct(F.regexp_extract(x, f"^({marker})", 1).alias("reference"), F.regexp_replace(x, f"^(?:{marker})", "").alias("body")))


def markdown_tables(lines: DataFrame) -> DataFrame:
    """(file, line_no, value) to (file, line_no, cells) of pipe tables, separator rows left out."""
    inner = F.regexp_replace(F.trim("value"), "^\\||\\|$", "")
    rows = lines.where(F.trim("value").startswith("|")).where(~F.col("value").rlike("^[\\s|:-]+$"))
    return rows.select("file", "line_no", F.transform(F.split(inner, "\\|"), lambda c: F.trim(c)).alias("cells"))


def strip_wikitext(text: str) -> str:
    """Wikitext without templates, comments, references, links' targets and quotes of emphasis."""
    text = re.sub(r"<!--.*?-->|<ref[^>]*/>|<ref.*?</ref>", "", text, flags=re.S)
    while (shorter := re.sub(r"\{\{[^{}]*\}\}", "", text)) != text:
        text = shorter
    text = re.sub(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1", text)
    return html.unescape(re.sub(r"'{2,}|<[^>]+>", "", text)).strip()


def tei_passages(document: bytes, lines_each: int = 20) -> Iterator[dict]:
    """Verse in chunks of ``lines_each`` lines within each division, else paragraphs: citation, text, lines, kind."""
    root = ElementTree.fromstring(document)
    name = lambda e: e.tag.rpartition("}")[2]
    flat = lambda e: " ".join("".join(e.itertext()).split())

    def walk(node, path: tuple[str, ...]) -> Iterator[dict]:
        if name(node) == "div" and node.get("n"):
            path = (*path, node.get("n"))
        own = [x for x in node if name(x) == "l"]
        for group in [x for x in node if name(x) == "lg"]:
            own += [x for x in group.iter() if name(x) == "l"]
        for at in range(0, len(own), lines_each):
            some = [(x.get("n") or str(at + k + 1), flat(x)) for k, x in enumerate(own[at : at + lines_each])]
            yield {"citation": ".".join((*path, some[0][0])), "text": "\n".join(t for _, t in some), "lines": [{"label": a, "text": t} for a, t in some], "kind": "verse"}
        for k, p in enumerate(x for x in node if name(x) == "p"):
            if text := flat(p):
                yield {"citation": ".".join((*path, p.get("n") or str(k + 1))), "text": text, "lines": [], "kind": "prose"}
        for child in node:
            if name(child) not in ("l", "lg", "p"):
                yield from walk(child, path)

    yield from walk(root, ())


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """All passages of the TEI files at a path, one file at a time on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        for pdf in batches:
            rows = [{"path": p, "place": k, **x} for p, c in zip(pdf["path"], pdf["content"], strict=True) for k, x in enumerate(tei_passages(c))]
            yield pd.DataFrame(rows, columns=["path", "place", "citation", "text", "lines", "kind"])

    return files.mapInPandas(parse, "path string, place int, citation string, text string, lines array<struct<label: string, text: string>>, kind string")


def year_interval(time: str, precision: int) -> tuple[int, int]:
    """First and last year of a dated value (``-0600-00-00T…``): by its precision - year 9, decade 8, century 7, millennium 6."""
    found = re.match(r"([+-]?)(\d+)-", time)
    if not found:
        raise ValueError(f"no year in {time!r}")
    year = int(found[2]) * (-1 if found[1] == "-" else 1)
    width = {9: 1, 8: 10, 7: 100, 6: 1000}.get(min(precision, 9))
    if width is None:
        raise ValueError(f"unsupported precision: {precision}")
    if width == 1:
        return year, year
    if width == 10:
        if year >= 0:
            return year // 10 * 10, year // 10 * 10 + 9
        # before our era decades count back from the year -1, as centuries do
    rank = -(-abs(year) // width)
    return ((rank - 1) * width + 1, rank * width) if year >= 0 else (-rank * width, -((rank - 1) * width + 1))
