"""Readable text of HTML pages by one walk over their tags with a stack of open tables, rows and cells."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Tags whose content is left out and tags that end a line; cells that only carry signs; white space, lines of page furniture.
SKIPPED, ENDS_LINE = ("script", "style", "head"), ("p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4")
EMPTY_CELLS = ("", "$", ")", "(", "%")
BLANKS = re.compile(r"[ \t   ]+")
PAGE_NOISE = re.compile(r"^\s*(table of contents|page\s*\d+|\d+\s*)$", re.I | re.M)


class _Walk(HTMLParser):
    """Collects strings outside of tables, and the lines of each outermost table in its place."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.hidden: str | None = None
        self.depth = 0  # open tables
        self.rows: list[list[list[str]]] = []  # of the outermost open table, in the order of their starts
        self.open: list[tuple[int, str, list]] = []  # open rows and cells with the table they belong to

    def _close(self, *kinds: str) -> None:
        """Ends what is open of these kinds in the innermost table, and all that was opened later."""
        for i, (depth, kind, _) in enumerate(self.open):
            if depth == self.depth and kind in kinds:
                del self.open[i:]
                break

    def handle_starttag(self, tag, attrs):
        if self.hidden == "head" and tag == "body":
            self.hidden = None
        if self.hidden:
            return
        if tag in SKIPPED:
            self.hidden = tag
        elif tag == "table":
            self.depth += 1
        elif tag == "tr" and self.depth:
            self._close("row", "cell")
            row: list = []
            self.rows.append(row)
            self.open.append((self.depth, "row", row))
        elif tag in ("td", "th") and self.depth:
            self._close("cell")
            cell: list[str] = []
            for _, kind, row in self.open:
                if kind == "row":
                    row.append(cell)
            self.open.append((self.depth, "cell", cell))
        elif tag == "br" and not self.depth:
            self.strings.append("\n")

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
        elif tag == "table" and self.depth:
            self._close("row", "cell")
            self.depth -= 1
            if not self.depth:
                self._emit()
        elif tag in ("tr", "td", "th") and self.depth:
            self._close("row" if tag == "tr" else "cell")
        elif tag in ENDS_LINE and tag != "br" and not self.depth:
            self.strings.append("\n")

    def handle_data(self, data):
        if self.hidden:
            return
        if not self.depth:
            self.strings.append(data)
        for _, kind, cell in self.open:
            if kind == "cell" and data.strip():
                cell.append(data.strip())

    def _emit(self) -> None:
        lines = []
        for row in self.rows:
            cells = [c for c in (BLANKS.sub(" ", " ".join(parts)) for parts in row) if c not in EMPTY_CELLS]
            if cells:
                lines.append(" | ".join(cells))
        self.strings.append("\n" + "\n".join(lines) + "\n")
        self.rows, self.open = [], []

    def text(self, html: str) -> str:
        self.feed(html)
        self.close()
        if self.depth:  # a table without end
            self._emit()
        whole = BLANKS.sub(" ", "\n".join(self.strings))
        lines = [line.strip() for line in PAGE_NOISE.sub("", whole).split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def page_text(html: str | None) -> str:
    """The text of a page; null is empty.

    A table becomes lines of its rows with cells parted by " | ", those of tables
    within it included, each where it begins; cells that are empty or a single sign go.  Tags
    that are left open end where the next of their kind begins, or their table ends.
    """
    return _Walk().text(html or "")


def read(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text) of every whole page."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([page_text(h) for h in batch.column(html).to_pylist()], pa.string())], names=[key, "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, text string")
