"""Main text of web pages, with removal of what a site repeats.

Element subtrees are hashed and counted for each host in Spark, in two ways: by their text, and by their structure (the
path of tags, classes and attribute names that leads to them, and the tags of their children), as menus, adverts and
footers mostly change their words from page to page but not their shape.  By structure only boxes beside the one that holds
most of a page's text are counted.  Subtrees that recur across a host's pages are its template and are deleted on every page of
it.  What tags, roles and names say of an element breaks the tie where a host has too few pages to tell.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmap.llm.shared import cut, map_arrow, masked, schema_with, written
from strandmap.llm.urlfilter import host_col

#: A subtree is a template if it is in this many different contents of its host at least, however many the host has.
MIN_PAGES = 3
#: A part of a box (a cell, an item, a heading) must be in this share of them as well: words like "yes" recur by themselves.
MIN_SHARE = 0.25
#: Up to this many templates of hosts are broadcast, as a sorted array of 8 bytes each; more are joined with pages by a shuffle.
BROADCAST_ROWS = 4_000_000

# Element names of the public HTML standard by their kind, and usual class names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html caption tbody td tfoot th thead tr optgroup option legend summary".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
SCOPES = frozenset("html body table ul ol dl select article main section div nav aside header footer form template".split())
DROPPED = frozenset("head script style template noscript iframe object embed svg math canvas audio video nav header footer aside form button select textarea input dialog menu search noembed noframes xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert alerts announcement popup modal overlay sidebar topbar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus respond replies "
    "share sharing social newsletter subscribe subscription related widget widgets toolbar pagination pager".split()
)
#: Names of a box that its structure alone never deletes.
KEPT_NAMES = frozenset("article body content entry headline intro lead main post standfirst story subtitle summary text title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside the article only boxes can be template; its paragraphs may be quoted on other pages.
BOXES = frozenset("div section aside ul ol dl table figure nav header footer form details".split())
PARTS = frozenset("li dt dd tr td th thead tbody tfoot caption h1 h2 h3 h4 h5 h6 legend summary figcaption option optgroup".split())

#: What leads from the page to its main text.
FRAME = frozenset("html body article main".split())

_START = re.compile(r"<(?:!--|([!?/])|([a-zA-Z][^\s/>]*))")
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Words of a class or id: ``site-footer``, ``siteFooter`` and ``SITE_FOOTER`` have the same.
NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class _Tags:
    """Ends of tags in a page, each found in the time its length takes: no part is tried again where it has failed."""

    def __init__(self, s: str):
        self.s, self.last = s, s.rfind(">")
        self.stop = max(self.last, s.rfind('"'), s.rfind("'"))
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """Place behind the tag's ``>``; one in quotes is none, unless the quotes don't lead to any other.  -1 if there is none."""
        p, seen = at, []
        while p <= self.stop:
            m = _STOP.search(self.s, p)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            q = self.s.find(m[0], m.end())
            if q < 0:
                break
            p = q + 1
        self.dead.update(seen)
        return self.s.find(">", at) + 1 or -1 if at <= self.last else -1


class Page:
    """Nodes of a page in document order and its text pieces (node, text); a piece of None is a block border.

    Takes time in proportion to the page's length, whatever is nested in it or left open.
    """

    def __init__(self, source: str | None):
        self.tag, self.parent, self.hash, self.chars, self.headed = ["#root"], [-1], [0], [0], [False]
        self.attributes: dict[int, str] = {}
        self.pieces: list[tuple[int, str | None]] = []
        self._hashing: list[list[str]] = [[]]
        self._stack = [0]
        #: Places in the stack of the open elements of each tag, and of those that stop a search.
        self._open_at: dict[str, list[int]] = {}
        self._scopes, self._blocks = [], []
        self._parse(source or "")
        while self._stack:
            self._close()
        self._find_main()
        self._judge()

    def _open(self, tag: str, attributes: str) -> None:
        node, at = len(self.tag), len(self._stack)
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.hash.append(0)
        self.chars.append(0)
        self.headed.append(tag in HEADINGS)
        if attributes and not attributes.isspace():
            self.attributes[node] = attributes
        self._hashing.append([])
        self._stack.append(node)
        self._open_at.setdefault(tag, []).append(at)
        if tag in SCOPES:
            self._scopes.append(at)
        if tag in BLOCK:
            self._blocks.append(at)
            self.pieces.append((node, None))

    def _close(self) -> None:
        node, inner = self._stack.pop(), self._hashing.pop()
        tag = self.tag[node]
        self.hash[node] = _hash("\x00".join([tag, *inner]))
        if not self._stack:
            return
        self._open_at[tag].pop()
        if tag in SCOPES:
            self._scopes.pop()
        if tag in BLOCK:
            self._blocks.pop()
            self.pieces.append((node, None))
        up = self._stack[-1]
        self.chars[up] += self.chars[node]
        self.headed[up] = self.headed[up] or self.headed[node]
        self._hashing[-1].append(f"\x01{self.hash[node]:x}")

    def _close_to(self, tags: set[str], stops: list[int]) -> None:
        """Close up to the outermost open element of these tags that is above the last of ``stops``, places in the stack."""
        least, found = stops[-1] if stops else 0, len(self._stack)
        for t in tags:
            own = self._open_at.get(t)
            if own:
                i = bisect_right(own, least)
                if i < len(own):
                    found = min(found, own[i])
        while len(self._stack) > found:
            self._close()

    def _text(self, raw: str) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        node = self._stack[-1]
        self.pieces.append((node, text))
        plain = " ".join(text.split())
        if plain:
            self.chars[node] += len(plain)
            self._hashing[-1].append(plain)

    def _parse(self, s: str) -> None:
        at, from_, tags = 0, 0, _Tags(s)  # text begins at ``at``; the next tag is looked for from ``from_`` on
        while True:
            m = _START.search(s, from_)
            if not m:
                self._text(s[at:])
                return
            start = m.start()
            if m[0] == "<!--":
                end = s.find("-->", m.end())
                self._text(s[at:start])
                at = from_ = end + 3 if end >= 0 else len(s)
                continue
            name = m[2] or ""
            if m[1]:
                closed = _CLOSE.match(s, start)
                end = tags.end(closed.end()) if closed else (s.find(">", m.end()) + 1 or -1 if start <= tags.last else -1)
            else:
                closed, end = None, tags.end(m.end())
            if end < 0:  # no tag: its sign is text
                from_ = start + 1
                continue
            self._text(s[at:start])
            at = from_ = end
            if closed:
                self._closing(closed[1].lower())
            elif name:
                at = from_ = self._opening(name.lower(), s[m.end() : end - 1], s, end)

    def _closing(self, tag: str) -> None:
        if tag in ("br", "p") and not self._open_at.get(tag):
            self.pieces.append((self._stack[-1], None if tag == "p" else " "))
        elif tag in BLOCK:
            self._close_to({tag}, self._open_at.get("table", []) if tag not in ("table", "article", "main", "body", "html") else [])
        else:
            self._close_to({tag}, self._blocks)

    def _opening(self, tag: str, attributes: str, s: str, at: int) -> int:
        """Open an element; gives the place behind it, or behind all of it where it holds no markup."""
        if tag in CLOSES_P:
            self._close_to({"p"}, self._scopes)
        if tag in SAME_LEVEL:
            self._close_to(SAME_LEVEL[tag], self._scopes)
        if tag in VOID:
            self.pieces.append((self._stack[-1], None if tag == "hr" else " " if tag == "br" else ""))
            return at
        self._open(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(s, at)
            self._hashing[-1].append(s[at : end.start()] if end else s[at:])
            self._close()
            return end.end() if end else len(s)
        if attributes.endswith("/") and tag not in BLOCK:
            self._close()
        return at

    # --- the main box ---

    def _find_main(self) -> None:
        """Descend from the page to the box that holds most of its text, and hash the structure of the boxes met beside the way.

        ``beside`` and ``along`` give (node, hash) of boxes off and on the way; ``main`` is where it ends, or 0 if that is no box.
        """
        self.kids: list[list[int]] = [[] for _ in self.tag]
        for i in range(1, len(self.tag)):
            self.kids[self.parent[i]].append(i)
        self.beside: list[tuple[int, int]] = []
        self.along: list[tuple[int, int]] = []
        node, path = 0, ""
        while True:
            groups: dict[str, list[int]] = {}
            for k in self.kids[node]:
                if self.chars[k] and (self.tag[k] in BOXES or self.tag[k] in FRAME):
                    groups.setdefault(self._shape(k), []).append(k)
            best = max(groups, key=lambda g: sum(self.chars[k] for k in groups[g]), default=None)
            if best is None or 2 * sum(self.chars[k] for k in groups[best]) < self.chars[node]:
                break
            for shape, own in groups.items():
                slot = _hash(f"\x02{path}>{shape}")
                (self.along if shape == best else self.beside).extend((k, slot) for k in own)
            node, path = max(groups[best], key=lambda k: self.chars[k]), f"{path}>{best.partition('{')[0]}"
        self.main = 0 if self.tag[node] in ("#root", "html", "body") else node

    def _shape(self, node: int) -> str:
        """Tag, classes and attribute names of an element, numbers in them left open, and the tags of its children."""
        own = ATTRIBUTE.findall(self.attributes.get(node, ""))
        names = sorted({n.lower() for n, *_ in own})
        classes = sorted({w for n, *v in own if n.lower() == "class" for w in "".join(v).lower().split()})
        tags = sorted({self.tag[k] for k in self.kids[node]})
        return _DIGITS.sub("#", f"{self.tag[node]}|{' '.join(classes)}|{' '.join(names)}") + "{" + " ".join(tags)

    def _names(self, node: int, whole: bool) -> set[str]:
        """Words of the element's classes and id; ``whole`` ones are not cut at signs and capitals."""
        out: set[str] = set()
        for name, *values in ATTRIBUTE.findall(self.attributes.get(node, "")):
            if name.lower() in ("class", "id"):
                value = "".join(values)
                out.update(value.lower().split() if whole else (w.lower() for w in NAME.findall(value)))
        return out

    def _judge(self) -> None:
        """``dropped``: what tag, role or name says is no main text.

        Names count for boxes alone; inside an article, or the box with most of the text, only where they are the whole class or id.
        A header in an article is its title where it has a heading.
        """
        n = len(self.tag)
        self.dropped, self.inner = [False] * n, [False] * n
        for i in range(1, n):
            tag, up = self.tag[i], self.parent[i]
            self.inner[i] = self.inner[up] or self.tag[up] in ("article", "main") or (up == self.main and up > 0)
            drop = tag in DROPPED and not (tag == "header" and self.inner[i] and self.headed[i])
            own = self.attributes.get(i)
            if own and not drop and tag not in FRAME:
                low = own.lower()
                if "hidden" in low or "role" in low:
                    for name, *values in ATTRIBUTE.findall(own):
                        name = name.lower()
                        drop = drop or name == "hidden" or (name == "role" and "".join(values).lower() in DROPPED_ROLES)
                if tag in BOXES and not drop and ("class" in low or "id" in low):
                    drop = not DROPPED_NAMES.isdisjoint(self._names(i, self.inner[i]))
            self.dropped[i] = drop

    def _inside(self, tags: tuple[str, ...]) -> list[bool]:
        inside = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            inside[i] = inside[self.parent[i]] or self.tag[i] in tags
        return inside

    def _framed(self) -> list[bool]:
        """Nodes that are, or hold, the frame of the page."""
        holds = [False] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            if self.tag[i] in FRAME or self.tag[i] == "head" or holds[i]:
                holds[i] = holds[self.parent[i]] = True
        return holds

    def candidates(self, short: bool = True) -> list[int]:
        """Nodes that may be a template by their text: no part of the page's frame, and inside an article or the main box only boxes; ``short``: not most of the page's text."""
        holds = self._framed()
        most = self.chars[0] / 2 if short else self.chars[0]
        return [i for i in range(1, len(self.tag)) if not holds[i] and self.chars[i] <= most and self.chars[i] and (self.tag[i] in BOXES if self.inner[i] else self.tag[i] in BLOCK)]

    def slots(self) -> list[tuple[int, int, bool]]:
        """(node, hash of the structure, whether it lies beside the way to the main box) of boxes that may be a template by their structure.

        Those with a heading, and with a name of KEPT_NAMES, are none.
        """
        holds = self._framed()
        may = lambda i: not holds[i] and not self.headed[i] and KEPT_NAMES.isdisjoint(self._names(i, False))
        return [(i, h, off) for rows, off in ((self.along, False), (self.beside, True)) for i, h in rows if may(i)]

    def main_hash(self) -> int:
        """Hash of the text of the main box, by which pages count as different."""
        return self.hash[self.main]

    def contents(self) -> list[int]:
        """For each node a hash of the content that it stands in: the text of its innermost article or main, or of the page outside of them.

        Text of dropped elements is left out, so that copies of a content with other advertisements or comments are one.
        """
        own, gone = [0] * len(self.tag), list(self.dropped)
        for i in range(1, len(self.tag)):
            own[i] = i if self.tag[i] in ("article", "main") else own[self.parent[i]]
            gone[i] = gone[i] or gone[self.parent[i]]
        texts: dict[int, list[str]] = {0: []}
        for node, piece in self.pieces:
            if piece and not gone[node]:
                for at in {0, own[node]}:
                    texts.setdefault(at, []).extend(piece.split())
        hashes = {at: _hash(" ".join(words)) for at, words in texts.items()}
        return [hashes.get(at, 0) for at in own]

    def hashes(self) -> list[tuple[int, int]]:
        """(node, hash) of all that may be a template, by text and by structure."""
        return [(i, self.hash[i]) for i in self.candidates(short=False)] + [(i, slot) for i, slot, _ in self.slots()]

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        """Blocks of the main text, joined by an empty line, without subtrees whose hashes are in ``templates``."""
        gone = list(self.dropped)
        if templates:
            for i, h in self.hashes():
                gone[i] = gone[i] or h in templates
        for i in range(1, len(self.tag)):
            gone[i] = gone[i] or gone[self.parent[i]]
        keep = [not g for g in gone]
        # An article, with the rest of the main element that it is in; else the main element.
        around = [False] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            around[i] = around[i] or (self.tag[i] == "article" and keep[i])
            around[self.parent[i]] = around[self.parent[i]] or around[i]
        inside = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            inside[i] = inside[self.parent[i]] or self.tag[i] == "article" or (self.tag[i] == "main" and around[i])
        for own in inside, self._inside(("main",)):
            if any(k and i and self.chars[n] for n, (k, i) in enumerate(zip(keep, own, strict=True))):
                keep = [k and i for k, i in zip(keep, own, strict=True)]
                break
        blocks, open_ = [], []
        for node, piece in self.pieces:
            if piece is None:
                if open_:
                    blocks.append(" ".join("".join(open_).split()))
                    open_ = []
            elif keep[node]:
                open_.append(piece)
        blocks.append(" ".join("".join(open_).split()))
        return "\n\n".join(b for b in blocks if b)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _counted(pages: DataFrame, host: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows (host, page, hash, ...) of the subtrees and structures of all pages, and the (host, hash) of those that are templates.

    By text: in MIN_PAGES different contents.  By structure: beside the main box in MIN_PAGES different contents, and in more of
    them than it is on the way to it.
    """

    def work(batches):
        for x in batches:
            out: list[tuple] = []
            for h, key, s in zip(*(x[c].to_pylist() for c in ("host", "page", "html")), strict=True):
                page = Page(s)
                content, few = page.contents(), set(page.candidates())
                out.append((h, key, 0, signed(content[0]), False, True, None))  # 0 counts the page itself
                out += {(h, key, signed(page.hash[i]), signed(content[i]), page.tag[i] in PARTS, i in few, None) for i in page.candidates(short=False)}
                out += {(h, key, signed(slot), signed(page.main_hash()), False, False, off) for _, slot, off in page.slots()}
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "page", "hash", "content", "part", "few", "beside"])

    own = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"), page_key(F.col(source)).alias("page"), F.col(source).alias("html"))
    rows = written(map_arrow(own, work, "host string, page string, hash long, content long, part boolean, few boolean, beside boolean"), "subtrees")
    each = rows.where("few or beside is not null").groupBy("host", "hash", "content").agg(F.min("part").alias("part"), F.max("beside").alias("beside"))
    counts = each.groupBy("host", "hash").agg(F.count("*").alias("n"), F.min("part").alias("part"), F.count_if("beside").alias("off"), F.count("beside").alias("slots"))
    # Of a structure ``off`` contents have it beside the way, the other ones of its ``slots`` on the way alone.
    counts = cut(counts.where(F.when(F.col("slots") > 0, (F.col("off") >= MIN_PAGES) & (2 * F.col("off") > F.col("slots"))).otherwise(F.col("n") >= MIN_PAGES)))
    of_host = counts.where("hash = 0").select("host", F.col("n").alias("contents"))
    found = counts.where("hash <> 0").join(of_host, "host", "left").where(~F.col("part") | (F.col("n") >= F.coalesce("contents", F.lit(0)) * MIN_SHARE))
    return rows, cut(found.select("host", "hash"))


def templates(pages: DataFrame, host: str = "host", source: str = "html") -> DataFrame:
    """(host, page, hashes): for each page (`page_key`) those of its subtrees and structures, as signed 64-bit hashes, that are templates of its host.

    An array holds hashes of its own page alone, however many templates a host has.
    """
    return _of_pages(*_counted(pages, host, source))


def _of_pages(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.select("host", "page", "hash").join(found, ["host", "hash"]).groupBy("host", "page").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))


class Known:
    """The templates of one host among the sorted keys (`_host_key`) of those of all hosts, as a set of hashes."""

    def __init__(self, keys: np.ndarray, host: str):
        self.keys, self.seed = keys, xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), 42)

    def __contains__(self, h: int) -> bool:
        key = np.int64(signed(xxhash.xxh64_intdigest(h.to_bytes(8, "little"), self.seed)))
        at = int(np.searchsorted(self.keys, key))
        return at < len(self.keys) and self.keys[at] == key

    def __bool__(self) -> bool:
        return len(self.keys) > 0


def _host_key(host: Column, hash_: Column) -> Column:
    """64-bit key of a host's template; `Known` makes the same of it."""
    return F.xxhash64(host, hash_)


def page_key(source):
    """What tells the pages of a host from each other; a null page is an empty one."""
    return F.md5(F.coalesce(source, F.lit("")))


def main_text(pages: DataFrame, url: str = "url", source: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text of each in column ``to`` (empty if there is none; null html is empty), html left out.

    White space inside a block is one space, character references are decoded, blocks are joined by an empty line.
    Null urls are a host of their own.  Repeated pages, and copies of a content, count once for the templates and keep a row
    each.  A box that is met as often on the way to the main box as beside it stays.  Long pages are read whole, in time
    proportional to their length.  Existing columns ``to`` are replaced, others may have any name; an empty table stays empty.
    """
    own, back, new = masked(pages, to, _host=F.coalesce(host_col(F.col(url)), F.lit("")), _html=F.col(source))
    kept = [c for n, c in new.items() if n != source]
    hosted = own.select(*kept, "_host", "_html")
    rows, found = _counted(hosted, "_host", "_html")
    if found.count() <= BROADCAST_ROWS:
        keys = np.sort(found.select(_host_key(F.col("host"), F.col("hash")).alias("k")).toArrow()["k"].to_numpy())
        shared = pages.sparkSession.sparkContext.broadcast(keys)

        def known(host, _):
            return Known(shared.value, host)

        joined = hosted.withColumn("_hashes", F.lit(None).cast("array<long>"))
    else:
        arrays = _of_pages(rows, found).withColumnsRenamed({"host": "_of", "page": "_page", "hashes": "_hashes"})
        joined = hosted.join(arrays, (F.col("_host") == F.col("_of")) & (page_key(F.col("_html")) == F.col("_page")), "left").select(*hosted.columns, "_hashes")

        def known(_, hashes):
            return frozenset(h & 0xFFFFFFFFFFFFFFFF for h in hashes or ())

    def work(batches):
        for x in batches:
            told = (x.column(len(kept) + i).to_pylist() for i in range(3))
            out = [Page(s).text(known(h, hashes)) for h, s, hashes in zip(*told, strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(kept)], pa.array(out, pa.string())], [*kept, "_text"])

    made = map_arrow(joined, work, schema_with(joined.select(*kept), _text="string"))
    return made.select(*[c for c, n in zip(back, new, strict=True) if n != source], F.col("_text").alias(to))
