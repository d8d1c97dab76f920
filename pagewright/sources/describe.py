"""Descriptions of documents by a model, as a table function: a document's pages go in, in order, and one record comes out.

    spark.udtf.register("describe", describer(ask))
    SELECT * FROM describe(TABLE(pages), 24000)

The function says by itself that pages are dealt out by document and sorted by index. Of a document's text it holds no more than the model is sent. A document that has its record already (``cached``, JSON text) is not read
on, and not asked about: the model is called once per document without one."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql.types import BooleanType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

from pagewright.functions.text import _EDGES, IMAGE_REF

#: A document's text -> its record
Ask = Callable[[str], dict]
FIELDS = ("title", "date", "issuer", "summary")
_PAGE = ("index", "header", "markdown", "footer", "cached")
_IMAGE = re.compile(IMAGE_REF)
_OMITTED = "\n\n[... middle omitted ...]\n\n"


class Clipped:
    """A text that is put together part by part, of which only beginning and end are kept where it gets too long."""

    def __init__(self, most: int) -> None:
        self.most, self.head, self.tail, self.length = most, "", "", 0

    def add(self, part: str) -> None:
        own = f"\n\n{part}" if self.length else part
        self.length += len(own)
        self.head = (self.head + own)[: self.most] if len(self.head) < self.most else self.head
        self.tail = (self.tail + own)[-self.most :]

    def text(self) -> str:
        if self.length <= self.most:
            return self.head
        first = self.most * 3 // 4
        return self.head[:first] + _OMITTED + self.tail[-(self.most - first) :]


def chunk(number: int, header: str | None, body: str | None, footer: str | None) -> str:
    """A page as the model sees it: its number, then its parts that aren't empty."""
    parts = [p for p in (header or "", _IMAGE.sub("", body or ""), footer or "") if p.strip(_EDGES)]
    return f"--- page {number} ---\n" + "\n".join(parts).strip(_EDGES)


def stand_in(text: str) -> dict:
    """Words of the first line, and the first ISO date if it is one."""
    first = re.match(r"--- page [0-9]+ ---\n([^\n]*)", text)
    found = re.search(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text)
    try:
        day = date.fromisoformat(found.group()).isoformat() if found else None
    except ValueError:
        day = None
    return {"title": re.sub(r"[^A-Za-z0-9 ]+", "", first.group(1) if first else "")[:40].strip(), "date": day}


def describer(ask: Ask = stand_in):
    """The table function over a model. Its input: index, header, markdown, footer, cached (null where there is no record); all other columns name the document. Its output: those, FIELDS, and asked, whether the model was."""
    from pyspark.sql.functions import udtf

    class Describe:
        @staticmethod
        def analyze(pages: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable:
                raise ValueError("the first argument is a table of pages: describe(TABLE(pages), most)")
            names = [f.name for f in pages.dataType]
            if missing := set(_PAGE) - set(names):
                raise ValueError(f"the pages have no {', '.join(sorted(missing))}")
            keys = [f for f in pages.dataType if f.name not in _PAGE]
            if not keys:
                raise ValueError("no column names the document")
            if not isinstance(most.value, int) or most.value < 1:
                raise ValueError("the second argument is the most characters that the model is sent")
            schema = StructType(list(keys))
            for name in FIELDS:
                schema = schema.add(name, StringType())
            return AnalyzeResult(schema.add("asked", BooleanType()), partitionBy=[PartitioningColumn(f"`{f.name}`") for f in keys], orderBy=[OrderingColumn("index")])

        def __init__(self) -> None:
            self.keys, self.record, self.text = None, None, None

        def eval(self, pages: Row, most: int) -> None:
            if self.keys is None:
                self.keys, self.text = tuple(v for n, v in pages.asDict().items() if n not in _PAGE), Clipped(most)
            if pages["cached"] is not None:
                self.record = json.loads(pages["cached"])
                raise SkipRestOfInputTableException("the document has its record")
            self.text.add(chunk(pages["index"] + 1, pages["header"], pages["markdown"], pages["footer"]))

        def terminate(self) -> Iterator[tuple]:
            if self.keys is None:
                return
            asked = self.record is None
            record = ask(self.text.text()) if asked else self.record
            yield (*self.keys, *(record.get(name) for name in FIELDS), asked)

    return udtf(Describe)
