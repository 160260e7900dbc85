"""Small reader for circuit tables and coordinates in one HTML page (runs inside mapInPandas)."""

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}


class _Reader(HTMLParser):
    """Collects every wikitable as rows of (tag, text, links) cells, and the first span.geo text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.geo = [], None
        self._open, self._cell, self._link, self._geo = [], None, None, None
        self._span_depth = 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        if tag == "table":
            self._open.append({"rows": [], "body": False} if "wikitable" in classes else None)
        elif tag == "span":
            if self._geo is not None:
                self._span_depth += 1
            elif self.geo is None and "geo" in classes:
                self._geo, self._span_depth = [], 1
        table = self._open[-1] if self._open else None
        if table is None:
            return
        if tag == "tbody":
            table["body"] = True
        elif tag == "tr":
            table["rows"].append([])
        elif tag in ("td", "th") and table["rows"]:
            self._cell = {"tag": tag, "text": [], "links": []}
            table["rows"][-1].append(self._cell)
        elif tag == "a" and self._cell is not None:
            self._link = {"href": attrs.get("href"), "text": []}
            self._cell["links"].append(self._link)

    def handle_endtag(self, tag):
        if tag == "table" and self._open:
            table = self._open.pop()
            if table is not None:
                self.tables.append(table)
        elif tag in ("td", "th"):
            self._cell = None
        elif tag == "a":
            self._link = None
        elif tag == "span" and self._geo is not None:
            self._span_depth -= 1
            if self._span_depth == 0:
                self.geo, self._geo = "".join(t.strip() for t in self._geo), None

    def handle_data(self, data):
        for sink in (self._cell and self._cell["text"], self._link and self._link["text"], self._geo):
            if sink is not None:
                sink.append(data)


def _score(table: dict) -> int:
    heads = [" ".join(c["text"]).lower() for row in table["rows"] for c in row if c["tag"] == "th"]
    weights = {"circuit": 2, "location": 1, "country": 1}
    return sum(w for word, w in weights.items() if any(word in h for h in heads))


def _text(link: dict) -> str:
    return "".join(t.strip() for t in link["text"])


def read_page(html: str, base_url: str) -> tuple[list[dict], float | None, float | None]:
    """Circuit rows of the best table of the page, and the page's own coordinates."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    rows = []
    best = max(reader.tables, key=_score, default=None)
    if best is not None and _score(best) >= 2:
        for row in best["rows"][1:]:
            cells = [c for c in row if c["tag"] == "td"]
            if len(cells) < 6:
                continue
            name, place, land = cells[0]["links"], cells[4]["links"], cells[5]["links"]
            if name and _text(name[0]) and name[0]["href"]:
                rows.append({
                    "circuit_name": _text(name[0]),
                    "circuit_url": base_url + name[0]["href"],
                    "locality": _text(place[0]) if place else None,
                    "country": _text(land[-1]) if land else None,
                })
    parts = (reader.geo or "").split(";")
    try:
        lat, lon = (float(p.strip()) for p in parts)
    except ValueError:
        lat = lon = None
    return rows, lat, lon
