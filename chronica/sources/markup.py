"""Marked-up documents to blocks: journal XML, label XML, label JSON."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "source_id string, seq int, kind string, level int, text string"
#: Elements whose text is left out of a paragraph.
SKIPPED = {"xref", "table-wrap", "fig", "label", "object-id"}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _words(node: ET.Element, skip: set[str]) -> str:
    """The text under a node without skipped elements, whose tails are kept."""
    parts = [node.text or ""]
    for child in node:
        if _local(child.tag) not in skip:
            parts.append(_words(child, skip))
        parts.append(child.tail or "")
    return " ".join("".join(parts).split())


def _rows(table: ET.Element) -> list[str]:
    """A table as lines: each cell after its column's header; a row with one cell is a group line."""
    lines: list[str] = []
    head: list[str] = []
    for row in (x for x in table.iter() if _local(x.tag) in ("tr", "row")):
        cells = [(_local(c.tag), _words(c, set())) for c in row]
        if cells and all(k == "th" for k, _ in cells) and not head:
            head = [t for _, t in cells]
        elif len(cells) == 1:
            lines.append(cells[0][1])
        else:
            lines.append("; ".join(f"{head[i]}: {t}" if i < len(head) and head[i] else t for i, (_, t) in enumerate(cells) if t))
    return [x for x in lines if x]


def journal_blocks(content: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of a journal article: headings by depth, paragraphs, list items, tables. Broken XML gives none."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return []
    out: list[tuple[str, int, str]] = []

    def walk(node: ET.Element, depth: int) -> None:
        for child in node:
            tag = _local(child.tag)
            if tag == "sec":
                walk(child, depth + 1)
            elif tag == "title":
                out.append(("heading", max(1, depth), _words(child, SKIPPED)))
            elif tag == "p":
                out.append(("paragraph", 0, _words(child, SKIPPED)))
            elif tag == "list":
                out.extend(("list", 0, _words(item, SKIPPED)) for item in child if _local(item.tag) == "list-item")
            elif tag == "table-wrap":
                lines = _rows(child)
                if lines:
                    out.append(("table", 0, "\n".join(lines)))
            else:
                walk(child, depth)

    walk(root, 0)
    return [(k, n, t) for k, n, t in out if t]


def label_sections(content: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of a drug label: section titles, then their paragraphs and tables in order."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return []
    out: list[tuple[str, int, str]] = []

    def walk(node: ET.Element, depth: int) -> None:
        for child in node:
            tag = _local(child.tag)
            if tag == "section":
                walk(child, depth + 1)
            elif tag == "title":
                out.append(("heading", max(1, depth), _words(child, set())))
            elif tag == "paragraph" or tag == "item":
                out.append(("paragraph", 0, _words(child, set())))
            elif tag == "table":
                lines = _rows(child)
                if lines:
                    out.append(("table", 0, "\n".join(lines)))
            else:
                walk(child, depth)

    walk(root, 0)
    return [(k, n, t) for k, n, t in out if t]


def blocks(documents: DataFrame, source_id: str, content: str, kind: str = "journal") -> DataFrame:
    """Blocks of each document, numbered in order. Null and broken documents have none."""
    parse = {"journal": journal_blocks, "label": label_sections}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *b) for i, c in zip(batch["i"], batch["c"]) for n, b in enumerate(parse(c))]
            yield pd.DataFrame(rows, columns=["source_id", "seq", "kind", "level", "text"])

    rows = documents.where(F.col(content).isNotNull()).select(F.col(source_id).cast("string").alias("i"), F.col(content).cast("string").alias("c"))
    return rows.mapInPandas(run, BLOCK)


def label_json_blocks(labels: DataFrame, source_id: str, sections: str) -> DataFrame:
    """Blocks of labels given as arrays of (title, text): a heading and a paragraph for each section."""
    each = labels.select(F.col(source_id).alias("source_id"), F.posexplode(sections).alias("n", "s"))
    pair = F.array(
        F.struct((F.col("n") * 2).alias("seq"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.col("s.title").alias("text")),
        F.struct((F.col("n") * 2 + 1).alias("seq"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.col("s.text").alias("text")),
    )
    return each.select("source_id", F.inline(pair)).where(F.trim("text") != "")


def pdf_blocks(content: bytes) -> list[tuple[str, int, str]]:
    """Paragraphs of a PDF, where a reader is installed; without one this raises."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise RuntimeError("reading PDF needs the package pypdf, which is not installed") from missing
    import io

    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    seen: dict[str, int] = {}
    for page in pages:
        for line in {"".join("#" if c.isdigit() else c for c in x.strip().lower()) for x in page.splitlines()}:
            seen[line] = seen.get(line, 0) + 1
    most = max(3, len(pages) // 4)  # a line on so many pages is a running head
    keep = lambda x: seen["".join("#" if c.isdigit() else c for c in x.strip().lower())] < most
    return [("paragraph", 0, " ".join(p.split())) for page in pages for p in "\n".join(x for x in page.splitlines() if keep(x)).split("\n\n") if p.strip()]
