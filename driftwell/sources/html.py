"""Links, tables and metas of an HTML page by the standard library's tolerant parser."""

from __future__ import annotations

from html.parser import HTMLParser

BREAKS = frozenset("address article br div dd dl dt footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class Page(HTMLParser):
    """links: (href, text, texts by line, first <time datetime>); rows: cells of each table row; metas; title; h1; text.

    An unclosed link ends at the next link, an unclosed cell at the next cell or row.
    """

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.rows: list[list[str]] = []
        self.metas: dict[str, str] = {}
        self.title: str | None = None
        self.h1: str | None = None
        self._words: list[str] = []
        self._link: dict | None = None
        self._cell: list[str] | None = None
        self._hold: str | None = None
        self._held: list[str] = []
        self._off = 0
        self.feed(markup)
        self.close()
        self._end_link()
        self._end_cell()
        self.text = "".join(self._words)

    def _end_link(self) -> None:
        if self._link:
            lines = [" ".join(x.split()) for x in "".join(self._link.pop("raw")).split("\n")]
            self._link["lines"] = [x for x in lines if x]
            self._link["text"] = " ".join(self._link["lines"])
            self.links.append(self._link)
            self._link = None

    def _end_cell(self) -> None:
        if self._cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self._cell).split()))
        self._cell = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style", "noscript"):
            self._off += 1
        if tag == "meta" and (name := a.get("property") or a.get("name")) and a.get("content", "").strip():
            self.metas.setdefault(name, a["content"].strip())
        elif tag == "a":
            self._end_link()
            self._link = {"href": a.get("href", "").strip(), "raw": [], "time": None}
        elif tag == "time" and self._link and self._link["time"] is None:
            self._link["time"] = a.get("datetime")
        elif tag == "tr":
            self._end_cell()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._end_cell()
            self._cell = [] if tag == "td" else None
        elif tag in ("title", "h1") and self._hold is None:
            self._hold, self._held = tag, []
        if tag in BREAKS:
            self._break()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self._off = max(0, self._off - 1)
        elif tag == "a":
            self._end_link()
        elif tag in ("td", "tr", "table"):
            self._end_cell()
        elif tag == self._hold:
            text = " ".join("".join(self._held).split())
            if getattr(self, tag) is None:
                setattr(self, tag, text)
            self._hold = None
        if tag in BREAKS:
            self._break()

    def _break(self) -> None:
        self._words.append("\n")
        if self._link:
            self._link["raw"].append("\n")

    def handle_data(self, data):
        if self._off:
            return
        self._words.append(data)
        if self._link:
            self._link["raw"].append(data)
        if self._cell is not None:
            self._cell.append(data)
        if self._hold:
            self._held.append(data)
