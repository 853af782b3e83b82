"""Saved portal pages to rows: hidden inputs, dropdown options, grid cells, links and buttons."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, kind string, row int, col int, name string, value string, text string, extra string"


class _Page(HTMLParser):
    """Collects (kind, row, col, name, value, text, extra) of one page; extra is 'selected' for an option, a link's onclick."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.select = self.link = self.option = None
        self.row = self.col = -1
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        kind = a.get("type", "").lower()
        if tag == "input" and kind == "hidden":
            self.out.append(("hidden", None, None, a.get("name", ""), a.get("value", ""), "", ""))
        elif tag == "input" and kind in ("image", "submit"):
            at = (self.row, self.col) if self.cell is not None else (None, None)
            self.out.append(("button", *at, a.get("name", ""), a.get("value", ""), "", kind))
        elif tag == "select":
            self.select = a.get("name", "")
        elif tag == "option":
            self.end_option()
            self.option = [a.get("value", ""), "", "selected" if "selected" in a else ""]
        elif tag == "tr":
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th"):
            self.end_cell()
            self.col, self.cell = self.col + 1, []
        elif tag == "a":
            self.end_link()
            self.link = [a.get("href"), "", a.get("onclick", "")]

    def handle_data(self, data: str) -> None:
        if self.option is not None:
            self.option[1] += data
        if self.cell is not None:
            self.cell.append(data)
        if self.link is not None:
            self.link[1] += data

    def handle_endtag(self, tag: str) -> None:
        if tag in ("option", "select"):
            self.end_option()
            self.select = None if tag == "select" else self.select
        elif tag in ("td", "th", "tr", "table"):
            self.end_cell()
        elif tag == "a":
            self.end_link()

    def end_option(self) -> None:
        if self.option is not None:
            self.out.append(("option", None, None, self.select or "", self.option[0], " ".join(self.option[1].split()), self.option[2]))
            self.option = None

    def end_cell(self) -> None:
        if self.cell is not None:
            self.out.append(("cell", self.row, self.col, "", "", " ".join("".join(self.cell).split()), ""))
            self.cell = None

    def end_link(self) -> None:
        if self.link is not None:
            at = (self.row, self.col) if self.cell is not None else (None, None)
            self.out.append(("link", *at, "", self.link[0], " ".join(self.link[1].split()), self.link[2]))
            self.link = None


def page_rows(pages: DataFrame) -> DataFrame:
    """One row per hidden input, option, cell, link and button of (page_id, html); page order isn't kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = _Page()
                page.feed(html or "")
                page.close()
                page.end_option()
                page.end_cell()
                page.end_link()
                for row in page.out:
                    for column, x in zip(out, (key, *row), strict=True):
                        column.append(x)
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["page_id", "kind", "row", "col", "name", "value", "text", "extra"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, SCHEMA)


def real_options(rows: DataFrame) -> DataFrame:
    """Option rows that aren't placeholders."""
    value = F.trim("value")
    return rows.filter((F.col("kind") == "option") & ~value.isin("", "0", "-1") & ~F.col("text").startswith("--"))


def selected(rows: DataFrame, field: str) -> DataFrame:
    """The selected option (page_id, value, text) of a dropdown, where a page has one."""
    chosen = rows.filter((F.col("kind") == "option") & (F.col("name") == field) & (F.col("extra") == "selected"))
    return chosen.select("page_id", "value", "text")


# Fixed value: how the portal's scripts post a link back.
POST_BACK = r"""WebForm_PostBackOptions\("[^"]+"|__doPostBack\('[^']+'"""


def grid_cells(rows: DataFrame) -> DataFrame:
    """(page, row, col, text, linked) of the pages' table cells: linked, if a cell holds a link to a file or back to the page, or a button."""
    leads = F.col("value").rlike(POST_BACK) | F.lower("value").endswith(".pdf") | (F.col("value").isNotNull() & (F.col("extra") != ""))
    found = rows.filter("row IS NOT NULL").filter((F.col("kind") == "button") | ((F.col("kind") == "link") & leads))
    linked = found.select(F.col("page_id").alias("page"), "row", "col").distinct().withColumn("linked", F.lit(True))
    cells = rows.filter("kind = 'cell'").select(F.col("page_id").alias("page"), "row", "col", "text")
    return cells.join(linked, ["page", "row", "col"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
