"""TEI volumes: one XML file each, read whole by Spark's binary reader and walked in Arrow batches.

Mixed content has an order that the built-in XML reader loses (text, footnote, text), so
each file is walked with the standard library's parser, one task a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What isn't part of a document's own text, and the number of persons kept.
APPARATUS = {"note", "pb", "fw"}
PERSONS = 40

MANIFEST = "volume_id string, path string, size_bytes long, sha256 string, status string, title string, title_volume string, sub_series string, editors array<string>, publication_date string, content_date_from string, content_date_to string, n_documents int, n_historical int"
DOCUMENTS = "volume_id string, document_id string, subtype string, doc_number string, head string, source_note string, date_from string, date_to string, date_display string, persons array<string>, text string"


def _tag(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def collapse(s: str) -> str:
    return " ".join(s.split())


def text_of(e, skip: set[str]) -> str:
    """The element's text without the subtrees to skip; what follows those stays, in order (A-6, A-7)."""
    out: list[str] = []

    def walk(x, top: bool) -> None:
        if top or (isinstance(x.tag, str) and _tag(x) not in skip):
            out.append(x.text or "")
            for child in x:
                walk(child, False)
                out.append(child.tail or "")

    walk(e, True)
    return collapse("".join(out))


def _find(e, tag: str, **attrs):
    return (x for x in e.iter() if _tag(x) == tag and all(_attr(x, k) == v for k, v in attrs.items()))


def header(root, stem: str) -> dict:
    """A volume's own data (A-2)."""
    titles = {_attr(t, "type"): collapse("".join(t.itertext())) for t in _find(root, "title") if _attr(t, "type")}
    ids = [collapse("".join(x.itertext())) for x in _find(root, "idno") if _attr(x, "type") not in ("", "isbn", "dbid")]
    divs = list(_find(root, "div", type="document"))
    dates = list(_find(root, "date"))
    content = [d for d in dates if _attr(d, "type") == "content-date"]
    issued = [d for d in dates if _attr(d, "type") == "publication-date"]
    return {
        "volume_id": next((x for x in ids if x), _attr(root, "id") or stem),
        "title": titles.get("complete", ""), "title_volume": titles.get("volume", ""), "sub_series": titles.get("sub-series", ""),
        "editors": [x for x in (collapse("".join(e.itertext())) for e in _find(root, "editor")) if x],
        "publication_date": collapse("".join(issued[0].itertext())) if issued else "",
        "content_date_from": _attr(content[-1], "notBefore")[:10] if content else "", "content_date_to": _attr(content[-1], "notAfter")[:10] if content else "",
        "n_documents": len(divs), "n_historical": sum(_attr(d, "subtype") == "historical-document" for d in divs), "status": "published" if divs else "planned",
    }


def persons(div) -> list[str]:
    """Different names outside the apparatus, first seen first, 40 at most (A-9)."""
    out: dict[str, None] = {}

    def walk(x) -> None:
        if isinstance(x.tag, str) and _tag(x) not in APPARATUS:
            if _tag(x) == "persName" and (name := text_of(x, APPARATUS)):
                out.setdefault(name)
            for child in x:
                walk(child)

    for child in div:
        walk(child)
    return list(out)[:PERSONS]


def documents(root, volume_id: str, subtypes: tuple[str, ...]) -> Iterator[dict]:
    """Document divisions that are wanted, have an id and a text (A-5 to A-10)."""
    for div in _find(root, "div", type="document"):
        if _attr(div, "subtype") not in subtypes or not _attr(div, "id"):
            continue
        body = text_of(div, APPARATUS | {"head"})
        if not body:
            continue
        heads = [x for x in div if _tag(x) == "head"]
        notes = [x for h in heads[:1] for x in _find(h, "note", type="source")]
        lines = [x for o in _find(div, "opener") for x in _find(o, "dateline")]
        when = [x for x in _find(div, "date") if _attr(x, "when")]
        yield {
            "volume_id": volume_id, "document_id": _attr(div, "id"), "subtype": _attr(div, "subtype"), "doc_number": _attr(div, "n"),
            "head": text_of(heads[0], APPARATUS) if heads else "", "source_note": collapse("".join(notes[0].itertext())) if notes else "",
            "date_from": (_attr(div, "doc-dateTime-min"))[:10], "date_to": (_attr(div, "doc-dateTime-max"))[:10],
            "date_display": text_of(lines[0], APPARATUS) if lines else text_of(when[0], APPARATUS) if when else "", "persons": persons(div), "text": body,
        }


def files(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """The folder's files, whole (A-1)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def _stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rpartition("/")[2])


def scan_manifest(xml: DataFrame) -> DataFrame:
    """One row a volume (A-2, A-3, A-4)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [header(ElementTree.fromstring(c), _stem(p)) | {"path": p, "size_bytes": n, "sha256": h} for p, n, h, c in zip(batch.path, batch.length, batch.sha256, batch.content, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return xml.select("path", "length", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(run, MANIFEST)


def scan_documents(xml: DataFrame, editorial_notes: bool = False) -> DataFrame:
    """One row a document; editorial notes too, by choice, as rows of their own subtype."""
    subtypes = ("historical-document", "editorial-note") if editorial_notes else ("historical-document",)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                root = ElementTree.fromstring(content)
                yield pd.DataFrame(list(documents(root, header(root, _stem(path))["volume_id"], subtypes)), columns=[c.split()[0] for c in DOCUMENTS.split(", ")])

    return xml.select("path", "content").mapInPandas(run, DOCUMENTS)


def with_references(xml: DataFrame, prefix_bytes: int = 400_000) -> DataFrame:
    """Files, but indexes, whose first bytes have a reference to a document (A-16)."""
    return xml.where(F.contains(F.substring("content", 1, prefix_bytes).cast("string"), F.lit('target="#d')) & ~F.col("path").contains("Index"))


def references(xml: DataFrame) -> DataFrame:
    """(volume_id, document_id, target, position) of references between documents (A-17)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                root = ElementTree.fromstring(content)
                volume = header(root, _stem(path))["volume_id"]
                for k, div in enumerate(_find(root, "div", type="document", subtype="historical-document")):
                    rows += [(volume, _attr(div, "id"), _attr(r, "target")[1:], k) for r in _find(div, "ref") if _attr(r, "target").startswith("#d")]
            yield pd.DataFrame(rows, columns=["volume_id", "document_id", "target", "position"])

    return xml.select("path", "content").mapInPandas(run, "volume_id string, document_id string, target string, position int")
