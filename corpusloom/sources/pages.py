"""HTML pages as documents: title, body without navigation, scripts and advertisements."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements whose text isn't the page's own.
SKIPPED = {"script", "style", "nav", "footer", "aside", "head"}


class _Walk(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.title: list[str] = []
        self.body: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "title":
            self.in_title = True
        if self.open:
            if tag == self.open[0]:
                self.open.append(tag)
        elif tag in SKIPPED or (tag == "div" and dict(attrs).get("class") == "ad"):
            self.open.append(tag)
        if tag in ("p", "br", "li", "h1", "h2", "div", "tr"):
            self.body.append(" ")

    def handle_endtag(self, tag) -> None:
        if tag == "title":
            self.in_title = False
        if self.open and tag == self.open[-1]:
            self.open.pop()

    def handle_data(self, data) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.open:
            self.body.append(data)


def parse(html: str) -> tuple[str, str]:
    walk = _Walk()
    walk.feed(html or "")
    walk.close()
    return " ".join("".join(walk.title).split()), " ".join("".join(walk.body).split())


def documents(pages: DataFrame) -> DataFrame:
    """page_id, head, text of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [parse(x) for x in batch.html]
            yield pd.DataFrame({"page_id": batch.page_id, "head": [h for h, _ in got], "text": [t for _, t in got]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, head string, text string")
