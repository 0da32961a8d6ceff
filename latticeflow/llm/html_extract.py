"""Main text of web pages: structure first, a host suffix array for the rest.

Each page is parsed into blocks. Blocks inside the article are kept and blocks
inside navigation, headers, footers, forms, adverts and the like are dropped. On
pages without an article the other blocks are open: the token streams of a
host's pages are concatenated, their suffixes are sorted by their first RUN
tokens, and runs that distinct pages share are removed as boilerplate; the
unique runs stay. The suffixes are dealt by host and prefix, so a host with a
third of all pages is spread over all tasks.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, arrow_map
from .url_filters import host_of

#: Tokens that a repeated run must have.
RUN = 8

#: Element names (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe noembed noframes template xmp svg math select option datalist".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
NEVER = set("nav footer aside form head dialog menu button label fieldset object audio video canvas map".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
#: Words of class and id that mark what is not main text (fixed values).
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead comment comments commentlist disqus replies reply respond share sharing social related "
    "recommended recommendations widget popup modal overlay toolbar search pagination pager copyright legal disclaimer hidden "
    "skip paywall teaser trending topbar bottombar form".split()
)
COMMENTS = set("comment comments commentlist disqus replies reply respond".split())
#: Words that beside a mark only say what kind of box it is (fixed values). A name
#: with any other word is about something: legal-history is no legal notice.
BOXES = set(
    "area bar block body bottom box btn button buttons card center col column container content desktop fixed grid group header heading "
    "hero holder icon icons image img inner inline item items js label large layout left link links list main message mobile module msg "
    "articles article outer page pages panel posts post primary right row secondary section site slot small sticky strip text thread "
    "title top unit view wide wrap wrapper zone us our ui div".split()
)
#: Words that only say how a container is laid out, or what it wraps, if they come first.
LAYOUT = set("with has no without".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[a-z]+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(raw)} if raw.strip(" /") else {}


def _marked(attrs: dict[str, str], in_article: bool) -> str:
    """'comments', 'marked' or '' from the attributes of an element."""
    if not attrs:
        return ""
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return "marked"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return "marked"
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        parts = _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if not parts or parts[0] in LAYOUT:
            continue
        words = set(parts)
        if not words <= MARKS | BOXES:
            continue
        if COMMENTS & words:
            return "comments"
        if MARKS & words or (parts == ["header"] or "site" in parts and "header" in parts) and not in_article:
            return "marked"
    return ""


class _Open:
    """An open element: its name, why it is skipped ("" if it isn't), whether it
    lies inside an article or main, and the skipped element around that article."""

    __slots__ = ("name", "why", "inside", "around", "closed")

    def __init__(self, name: str, why: str, inside: str, around: _Open | None):
        self.name, self.why, self.inside, self.around = name, why, inside, around
        self.closed = False


class _Page:
    """One pass over a page: blocks as (kind, text); kind is keep, drop or open.

    An article inside a skipped element goes with it, if that element is closed
    after it; one that was left open by mistake does not hide the article."""

    def __init__(self, source: str):
        self.found: list[tuple[str, _Open | None, str]] = []
        self.text: list[str] = []
        self.off: list[str] = []  # skipped text; its element may be in the midst of a paragraph
        self.at = _Open("", "", "", None)
        self.stack: list[_Open] = []
        self._scan(source)
        self._flush()
        hidden = lambda o: o is not None and o.closed
        self.blocks = [("drop" if hidden(around) else kind, words) for kind, around, words in self.found]

    def _top(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", "", "", None)

    def _say(self, text: str) -> None:
        top = self._top()
        if top.why:
            self.off.append(text)
        else:
            if not self.text:
                self.at = top
            self.text.append(text)

    def _flush(self) -> None:
        if self.text:
            if words := " ".join("".join(self.text).split()):
                self.found.append((self.at.inside or "open", self.at.around, words))
            self.text = []
        if self.off:
            if words := " ".join("".join(self.off).split()):
                self.found.append(("drop", None, words))
            self.off = []

    def _scan(self, source: str) -> None:
        at = 0
        while m := _TAG.search(source, at):
            if m.start() > at:
                self._say(html.unescape(source[at : m.start()]))
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._end(name)
            elif name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else len(source)
                if name in ("select", "svg", "math"):
                    self._say(" ")
            else:
                self._start(name, m[3] or m[6] or "")
        if at < len(source):
            self._say(html.unescape(source[at:]))

    def _pop(self, names: set[str], stop: set[str]) -> None:
        """Close the innermost open element of names, unless one of stop is inside it."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name in names:
                if self.stack[k].name in BLOCK:
                    self._flush()
                del self.stack[k:]
                return
            if self.stack[k].name in stop:
                return

    def _start(self, name: str, raw: str) -> None:
        if name in BLOCK:
            self._flush()
            self._pop({"p"}, BLOCK - {"p"})
        elif name in ("br", "td", "th", "img", "input"):
            self._say(" ")
        if name in CLOSES:
            self._pop(*CLOSES[name])
        if name in VOID or raw.endswith("/") and name not in BLOCK:
            return
        top = self._top()
        why, inside, around = top.why, top.inside, top.around
        mark = _marked(_attributes(raw), bool(inside)) if name not in ("html", "body") else ""
        if mark:
            why = why or mark
        elif name in ("article", "main") and why not in ("comments", "aside", "footer"):
            if name == "article" and inside != "article" or name == "main" and not inside:
                if why:
                    around = next(o for o in self.stack if o.why)
                why, inside = "", name
        elif not why:
            why = name if name in NEVER else "header" if name == "header" and not inside else ""
        self.stack.append(_Open(name, why, inside, around))

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        elif name == "br":
            self._say(" ")
        stop = set() if name in ("html", "body", "article", "main", "div", "section") else {"article", "main", "table"} - {name}
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                self.stack[k].closed = True
                del self.stack[k:]
                return
            if self.stack[k].name in stop:
                return


def parse(source: str | None) -> tuple[list[str] | None, list[str], list[str]]:
    """(kept blocks, or None if the page has no article, open blocks, dropped blocks) in page order."""
    page = _Page(source or "")
    by = {k: [t for kind, t in page.blocks if kind == k] for k in ("article", "main", "open", "drop")}
    kind = "article" if by["article"] else "main" if by["main"] else None
    if kind is None and not by["open"]:
        return [], [], by["drop"]
    return (by[kind], [], by["drop"] + by["open"]) if kind else (None, by["open"], by["drop"])


def _suffixes(tokens: list[str]) -> np.ndarray:
    """A hash of the first RUN tokens of each suffix that has as many."""
    if len(tokens) < RUN:
        return np.empty(0, np.int64)
    one = np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    total = np.zeros(len(tokens) - RUN + 1, np.uint64)
    for k in range(RUN):
        total = total * np.uint64(0x9E3779B97F4A7C15) + one[k : k + len(total)]
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def _unique_runs(blocks: list[str], covered: list[int]) -> str:
    """The blocks without the tokens that repeated runs cover."""
    sizes = [len(b.split()) for b in blocks]
    gone = np.zeros(sum(sizes) + RUN, bool)
    for p in covered:
        gone[p : p + RUN] = True
    out, at = [], 0
    for block, n in zip(blocks, sizes, strict=True):
        left = [w for w, g in zip(block.split(), gone[at : at + n].tolist(), strict=True) if not g]
        at += n
        if left:
            out.append(" ".join(left))
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (id, url, text, n_chars) per row of pages; text holds the blocks
    of the main text joined by two line feeds, empty if there are none.

    Null and empty pages give empty text; pages whose url has no host form one
    host. Pages cut short, tags left open and repeated rows are fine; a page
    whose copies repeat it whole counts as one page for the suffix array. Extra
    columns are ignored; an empty table gives an empty result.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType(
        [
            T.StructField("id", pages.schema["id"].dataType),
            T.StructField("url", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("blocks", T.ArrayType(T.StringType())),
            T.StructField("dropped", T.StringType()),
        ]
    )

    def run(batch: pa.RecordBatch) -> dict:
        got = [parse(x) for x in batch.column(2).to_pylist()]
        return {
            "id": batch.column(0),
            "url": batch.column(1),
            "text": [None if kept is None else "\n\n".join(kept) for kept, _, _ in got],
            "blocks": [blocks if kept is None else None for kept, blocks, _ in got],
            "dropped": [" ".join(drop) for _, _, drop in got],
        }

    parsed = arrow_map(pages, run, schema).withColumn("row", F.monotonically_increasing_id())
    parsed = Table(parsed.withColumn("host", host_of(F.col("url"))), "parsed").df
    sure = parsed.where("text is not null").select("id", "url", "text")
    asked = parsed.where("text is null")
    if asked.isEmpty():
        return sure.withColumn("n_chars", F.length("text").cast("long"))
    streams = parsed.join(asked.select("host").distinct(), "host", "left_semi").select("row", "host", "blocks", "dropped")
    places = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("row", "place", "prefix", "page")] + [T.StructField("host", T.StringType())]
    )

    def suffixes(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in places.fieldNames()}
        for row, host, blocks, dropped in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            # Positions below 0 belong to dropped blocks: they bear witness, but need no removal.
            parts = [(0, " ".join(blocks or []).split()), (-(1 << 40), (dropped or "").split())]
            page = xxhash.xxh64_intdigest(" ".join(blocks or [dropped or ""])) >> 1
            for start, tokens in parts:
                h = _suffixes(tokens)
                out["row"] += [row] * len(h)
                out["place"] += range(start, start + len(h))
                out["prefix"] += h.tolist()
                out["page"] += [page] * len(h)
                out["host"] += [host] * len(h)
        return out

    sorted_ = arrow_map(streams, suffixes, places)
    # Equal prefixes of distinct pages are neighbours in the host's suffix array; min and max tell whether there are two.
    repeated = sorted_.groupBy("host", "prefix").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a < b").select("host", "prefix")
    covered = (
        sorted_.where("place >= 0").join(repeated, ["host", "prefix"], "left_semi").groupBy("row").agg(F.collect_list("place").alias("covered"))
    )
    final = T.StructType([schema["id"], schema["url"], schema["text"]])

    def cut(batch: pa.RecordBatch) -> dict:
        text = [_unique_runs(b, c or []) for b, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return {"id": batch.column(0), "url": batch.column(1), "text": text}

    rest = arrow_map(asked.join(covered, "row", "left").select("id", "url", "blocks", "covered"), cut, final)
    return sure.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
