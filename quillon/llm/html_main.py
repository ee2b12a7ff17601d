"""Main text of web pages: what is left of a page without its site's templates and its own furniture.

A page is read as a stream of tags, and the subtree of every element that holds
text is hashed, menus, adverts and footers included. The hashes are counted per
host in Spark; subtrees that recur on many different pages of a host are its
templates, come back by a join on the host and are deleted first. What no other
page repeats is then judged by the page alone: elements whose tag, role, class or
id says that they are navigation, advertising, forms, comments and the like go.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

# HTML element names by their role in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head title script style noscript template iframe svg math canvas object button select textarea input label noembed noframes audio video".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
BARRIERS = frozenset("ul ol dl table div section article main aside nav header footer body blockquote form td th".split())
#: Words of a class, id or role that name page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets related recommended share sharing social footer header masthead "
    "comment comments respond replies disqus subscribe newsletter signup login search contentinfo complementary form skip toolbar tags toc".split()
)
#: No alternative gives anything back, so a page takes time in proportion to its length however its tags are broken; a tag that a page's end cuts off is no text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?+)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[/a-zA-Z][^<>]*+\Z", re.S
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
#: Words that name what readers say, which is never the article.
COMMENTS = frozenset("comment comments respond replies disqus".split())
#: Prime and base of the running hash over blocks.
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687
_ABOUT = frozenset("has no not with without is".split())  # "has-sidebar" speaks of a sidebar elsewhere


def _furniture(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    if not attributes or tag in ("body", "html", "article", "main") and "comment" not in attributes.lower():
        return False
    if _HIDDEN.search(attributes):
        return True
    for _, value in _NAMES.findall(attributes):
        plain = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)
        for name in plain.lower().strip("\"'").split():
            found = _WORD.findall(name)
            if found and found[0] not in _ABOUT and any(w in FURNITURE for w in found):
                return True
    return False


def _of_readers(attributes: str) -> bool:
    return any(w in COMMENTS for _, value in _NAMES.findall(attributes) for w in _WORD.findall(value.lower()))


class Page:
    """Blocks of text in page order, each with what it stands in, and the subtrees that hold them.

    ``blocks`` are (text, in main element, in furniture); ``subtrees`` are
    (first block, end block, hash, in main element) of all elements that hold
    text, furniture included.

    Names mislead where they speak of a whole layout ("content-with-sidebar", a
    form around the page). Where they leave less than a quarter of a page, an
    element of such a name (or a form) that holds more than half of the page's
    text is no furniture, if an article is marked in or around it or nothing at
    all is left; what is named after readers' comments always is.
    """

    def __init__(self, text: str | None) -> None:
        self.blocks: list[tuple[str, bool, bool]] = []
        self.subtrees: list[tuple[int, int, int, bool]] = []
        self._piece: list[str] = []
        self._stack: list[tuple[str, bool, bool, bool, int, str, bool]] = []  # tag, no text, furniture, main, first block, its own furniture, marks an article
        self._named: list[tuple[int, int, str]] = []  # furniture of its own: first block, end block, kind
        self._marked: list[tuple[int, int]] = []
        self._running = [0]
        if text:
            self._read(text)
            self._relieve()

    def _relieve(self) -> None:
        chars = [0]
        for t, *_ in self.blocks:
            chars.append(chars[-1] + len(t))
        left = sum(len(t) for t, _, out in self.blocks if not out)
        if 4 * left >= chars[-1]:
            return
        near = lambda a, b: not left or any(a <= x and y <= b or x <= a and b <= y for x, y in self._marked)
        large = {(a, b, kind) for a, b, kind in self._named if kind == "name" and 2 * (chars[b] - chars[a]) > chars[-1] and near(a, b)}
        if large:
            covered = lambda spans: list(accumulate(self._steps(spans)))
            out, main = covered([(a, b) for a, b, kind in self._named if (a, b, kind) not in large]), covered(self._marked)
            self.blocks = [(t, main[i] > 0, out[i] > 0) for i, (t, _, _) in enumerate(self.blocks)]

    def _steps(self, spans: list[tuple[int, int]]) -> list[int]:
        steps = [0] * (len(self.blocks) + 1)
        for a, b in spans:
            steps[a] += 1
            steps[b] -= 1
        return steps

    def _flush(self) -> None:
        if self._piece:
            text = " ".join(html.unescape("".join(self._piece)).split())
            self._piece = []
            if text:
                out, main = self._stack[-1][2:4] if self._stack else (False, False)
                self.blocks.append((text, main, out))
                self._running.append((self._running[-1] * _BASE + xxhash.xxh64_intdigest(text)) % _PRIME)

    def _pop(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag, mute, out, main, first, own, marks = self._stack[-1]
            if tag not in INLINE or out and not (len(self._stack) > 1 and self._stack[-2][2]):
                self._flush()
                if not mute and len(self.blocks) > first and tag not in ("html", "body"):
                    content = (self._running[-1] - self._running[first] * pow(_BASE, len(self.blocks) - first, _PRIME)) % _PRIME
                    self.subtrees.append((first, len(self.blocks), xxhash.xxh64_intdigest(f"{tag}\x1e{main}\x1e{len(self.blocks) - first}\x1e{content}") - (1 << 63), main))
            if len(self.blocks) > first:
                if own:
                    self._named.append((first, len(self.blocks), own))
                if marks:
                    self._marked.append((first, len(self.blocks)))
            self._stack.pop()

    def _read(self, text: str) -> None:
        at, end = 0, len(text)
        while at < end:
            found = _TOKEN.search(text, at)
            if found is None:
                self._text(text[at:])
                break
            if found.start() > at:
                self._text(text[at : found.start()])
            at = found.end()
            tag = found.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if found.group(1):
                self._close(tag)
                continue
            attributes = found.group(3) or ""
            self._open(tag, attributes, attributes.endswith("/"))
            if tag in RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                at = stop.start() if stop else end
        self._pop(0)
        self._flush()

    def _text(self, piece: str) -> None:
        if not (self._stack and self._stack[-1][1]):
            self._piece.append(piece)

    def _open(self, tag: str, attributes: str, empty: bool) -> None:
        if tag == "br":
            self._text("\n")
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        ends = CLOSES.get(tag)
        if ends or tag not in INLINE:
            # a new block ends an open paragraph; a new item ends the one before it
            wanted = (ends or frozenset()) | {"p"}
            for depth in range(len(self._stack) - 1, -1, -1):
                if self._stack[depth][0] in wanted:
                    self._pop(depth)
                elif self._stack[depth][0] in BARRIERS:
                    break
        if tag not in INLINE:
            self._flush()
        if empty and tag in ("svg", "path", "circle", "rect"):
            return
        mute, out, main = self._stack[-1][1:4] if self._stack else (False, False, False)
        inside = out
        mute = mute or tag in NO_TEXT
        own = ""
        if _furniture(tag, attributes):
            by_name = (tag not in ASIDE or tag == "form") and not _HIDDEN.search(attributes) and not _of_readers(attributes)
            own = "name" if by_name else "always"
        out = out or mute or bool(own)
        marks = tag in ("article", "main") or "articlebody" in attributes.lower()
        main = main or (not out and marks)
        if out and not inside:
            self._flush()
        self._stack.append((tag, mute, out, main, len(self.blocks), own, marks and own != "always"))

    def _close(self, tag: str) -> None:
        for depth in range(len(self._stack) - 1, -1, -1):
            name = self._stack[depth][0]
            if name == tag:
                self._pop(depth)
                return
            if name in BARRIERS and tag not in BARRIERS:
                return

    def main_text(self, templates: frozenset[int] = frozenset(), by_names: bool = True) -> str:
        """Text without the templates; with ``by_names`` also without furniture and, where a main element is marked, what lies around it."""
        drop = bytearray(len(self.blocks))
        if templates:
            for first, end, digest, _ in self.subtrees:
                if digest in templates:
                    drop[first:end] = b"\1" * (end - first)
        if not by_names:
            return " ".join(t for i, (t, _, _) in enumerate(self.blocks) if not drop[i])
        only_main = any(main and not out for _, main, out in self.blocks)
        return " ".join(t for i, (t, main, out) in enumerate(self.blocks) if not drop[i] and not out and (main or not only_main))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, subtrees, mains = [], [], []
        for text in batch.column("html"):
            page = Page(text.as_py())
            keys.append(xxhash.xxh64_intdigest("\x1f".join(t for t, _, out in page.blocks if not out)) - (1 << 63))
            subtrees.append(sorted({h for _, _, h, main in page.subtrees if not main}))
            mains.append(sorted({h for _, _, h, main in page.subtrees if main}))
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(keys, pa.int64()), pa.array(subtrees, lists), pa.array(mains, lists)], names=["host", "page", "around", "inside"])


def site_templates(pages: DataFrame, *, least_pages: int = 5, least_share: float = 0.5, least_main_share: float = 0.9) -> DataFrame:
    """(host, templates): hashes of the subtrees on at least ``least_share`` of a host's different pages, and at least ``least_pages`` of them.

    Within a marked main element the share is ``least_main_share``: a passage
    that many articles quote is no template. Pages of equal text (furniture
    aside) count once, so copies of one page make none. A host has no more
    templates than a few pages have subtrees.
    """
    scanned = pages.select("host", "html").mapInArrow(_hashes, "host string, page long, around array<long>, inside array<long>")
    different = materialize(scanned.groupBy("host", "page").agg(F.min(F.struct("around", "inside")).alias("has")).select("host", "has.*"), "page-subtrees")
    sizes = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    around = F.transform("around", lambda h: F.struct(h.alias("subtree"), F.lit(False).alias("main")))
    inside = F.transform("inside", lambda h: F.struct(h.alias("subtree"), F.lit(True).alias("main")))
    counts = different.select("host", F.explode(F.concat(around, inside)).alias("s")).groupBy("host", "s.subtree", "s.main").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    share = F.when(F.col("main"), least_main_share).otherwise(least_share)
    often = counts.join(sizes, "host").where(F.col("n") >= F.col("pages") * share)
    return often.groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def _extract(by_names: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset] = {}
        for batch in batches:
            texts = []
            for source, templates in zip(batch.column("html"), batch.column("templates"), strict=True):
                found = tuple(templates.as_py() or ())
                if found not in known:
                    known = {found: frozenset(found)}
                texts.append(Page(source.as_py()).main_text(known[found], by_names))
            keep = [c for c in batch.schema.names if c not in ("html", "templates")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return run


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", by_names: bool = True, **thresholds: float) -> DataFrame:
    """Per page: id, url, ``text``.

    The site's templates are deleted first; ``by_names=False`` stops there.
    Where a page marks its article (``article``, ``main`` or an article body)
    the text is taken from there, else from the body. Character references are
    decoded, white space inside a block becomes one space, blocks are joined
    in page order by one space. A page of any length, however broken its tags, is
    read once from start to end; a tag that the page's end cuts off is no text.
    A null or empty page has an empty text; a page
    with a null URL belongs to the host of no name; repeated rows each return
    a row; an empty table gives an empty result; other columns are ignored.
    ``thresholds`` are those of ``site_templates``.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    templates = materialize(site_templates(rows, **thresholds), "templates")
    joined = rows.join(templates, "host", "left").select("_id", "_url", "html", "templates")
    kinds = [joined.schema[c].dataType.simpleString() for c in ("_id", "_url")]
    out = joined.mapInArrow(_extract(by_names), f"_id {kinds[0]}, _url {kinds[1]}, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
