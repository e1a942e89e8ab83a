"""Main text of web pages by equivalence-class template deduction (operator 7).

1. Every page is read into tokens: a markup token is the path of open elements
   with their classes and ids, a text token a path with the text of a block. A
   path is a node with a parent and a 64-bit hash, so a page costs time and memory
   linear in its length, however deep or unclosed its markup is. Each page adds,
   for every token of it, a hash of (page, times) to the sum of (host, token).
   Equal sums mean equal occurrence vectors over the host's pages, so the tokens
   of a host with the same sum are one equivalence class; no vector is ever
   gathered, and a host of any size is summed before the shuffle.
2. A class is valid with two tokens or more that occur on ``MIN_PAGES`` pages or
   more and on at least ``MIN_SHARE`` of the host's. Paths nest, so the valid
   classes nest into the host's template: its markup tokens frame the slots, and
   its text tokens are fixed wording. The slot of the article is the deepest frame
   that holds ``MAIN_SHARE`` of the host's text outside noise. Frames are
   containers that occur once on each of their pages (a paragraph or heading is
   content, not a frame), and article and main elements, any number of times;
   what is inside one of these is content too.
3. Each page gives the text of its host's slot without noise, that is, elements
   that are menus, headers, footers, sidebars, notices, adverts, forms, comments or
   hidden, by element, role, class or id. In a slot that is no article or main
   element the template's fixed wording goes too, unless that is all the slot
   holds (a host of equal pages).

No template can be deduced for a host with fewer than ``MIN_PAGES`` pages, and a
page may lack its host's slot. Such a page gives its article or main element, or
else its body without noise and fixed wording.

Blocks are joined by one space, in page order, references decoded, white space
folded. Null html or url: empty text, a host of its own. Repeated rows each
give a row and count as one page each. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitlend.llm.common import own_columns, prepare, stored

MIN_PAGES = 2
MIN_SHARE = 0.5
MAIN_SHARE = 0.6

# fixed values: element names of the HTML standard, and words that sites use
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe object svg math title textarea select option datalist head "
                "canvas audio video xmp noframes".split())
NOISE = frozenset("nav footer aside form button dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
                  "toolbar".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
                  "cookies consent gdpr notice popup modal overlay sidebar menu nav navbar navigation breadcrumb "
                  "breadcrumbs footer share sharing social comment comments commentlist reply replies respond disqus "
                  "newsletter subscribe signup login related recommended widget toolbar pagination pager masthead "
                  "topbar skip".split())
MAIN = ("article", "main")
CONTAINERS = frozenset("html body div section center table tbody tr td".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
          "option": "option"}
BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                         "header hr main menu nav ol p pre section table ul".split())

# Possessive, and an unclosed quote ends with its tag: no part of a page is read twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|"
                    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:[\"'][^>]*+)?)(?:>|$)|([^<]+|<)", re.S)
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))|"
                   r"(?<![\w-])(hidden)(?![\w-])")
_PART = re.compile(r"[a-z0-9]+")


def _noisy(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in NOISE or tag == "header" and not in_main:
        return True
    if not attrs or tag in ("html", "body", *MAIN):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    said = set(_PART.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    return bool(said & WORDS or "header" in said and not in_main)


#: Kinds of tokens: content, a container outside article and main elements, such
#: an element itself, and text.
PART, CONTAINER, ARTICLE, TEXT = range(4)


class Page:
    """A page's markup tokens, each a list entry by its number (0 is the page):
    ``parent`` (a smaller number), ``key`` (hash of its path), ``depth``, ``kind``
    and ``times``; and its ``blocks`` in order: (markup token, text, inside noise)."""

    def __init__(self, text: str):
        self.parent, self.key, self.depth, self.kind, self.times = [0], [0], [0], [PART], [0]
        self.blocks: list[tuple[int, str, bool]] = []
        self._child: dict[tuple[int, str], int] = {}
        self._open: list[tuple[str, int, bool]] = []  # element, token, noise
        self._names: Counter[str] = Counter()  # of the open elements
        self._inside = 0  # open article and main elements
        self._run: list[str] = []
        self._read(text)

    def _end_block(self) -> None:
        if self._run:
            raw = "".join(self._run)
            self._run = []
            said = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if said:
                _, token, noise = self._open[-1] if self._open else ("", 0, False)
                self.blocks.append((token, said, noise))

    def _pop(self) -> str:
        name = self._open.pop()[0]
        self._names[name] -= 1
        self._inside -= name in MAIN
        return name

    def _close(self, name: str) -> None:
        while self._names[name]:
            if self._pop() == name:
                return

    def _token(self, at: int, tag: str, mark: str) -> int:
        """The token of an element inside token ``at``."""
        token = self._child.setdefault((at, mark), len(self.key))
        if token == len(self.key):
            self.parent.append(at)
            self.key.append(xxhash.xxh64_intdigest(mark, self.key[at]) >> 1)
            self.depth.append(self.depth[at] + 1)
            self.kind.append(PART if self._inside else ARTICLE if tag in MAIN else CONTAINER if tag in CONTAINERS else PART)
            self.times.append(0)
        self.times[token] += 1
        return token

    def text_key(self, token: int, said: str) -> int:
        return xxhash.xxh64_intdigest(said, self.key[token] + 1) >> 1

    def inside(self, found: list[bool]) -> list[bool]:
        """Whether each markup token is, or lies in, a found one."""
        out = list(found)
        for token in range(1, len(out)):
            out[token] = out[token] or out[self.parent[token]]
        return out

    def mass(self) -> list[int]:
        """Characters outside noise in each markup token."""
        out = [0] * len(self.key)
        for token, said, noise in self.blocks:
            out[token] += 0 if noise else len(said)
        for token in range(len(out) - 1, 0, -1):
            out[self.parent[token]] += out[token]
        return out

    def _read(self, text: str) -> None:
        at, size = 0, len(text)
        unclosed = set()  # raw elements without an end from here on
        while at < size:
            m = _TOKEN.match(text, at)
            if m is None:
                at += 1
                continue
            at = m.end()
            if m.group(4) is not None:
                self._run.append(m.group(4))
                continue
            if m.group(2) is None:
                continue
            tag = m.group(2).lower()
            if m.group(1):
                if tag not in INLINE or self._open and self._open[-1][0] == tag:
                    self._end_block()
                    self._close(tag)
                continue
            if tag in RAW and tag != "head":
                end = None
                if tag not in unclosed:
                    end = re.compile(rf"</{re.escape(tag)}\s*+(?:>|$)", re.I).search(text, at)
                    if end is None:
                        unclosed.add(tag)
                if tag not in ("svg", "math", "option"):
                    self._end_block()
                at = end.end() if end else (size if tag in ("script", "style") else at)
                continue
            if tag == "br":
                self._run.append(" ")
                continue
            noted = m.group(3)
            attrs = {}
            if noted and ("=" in noted or "hidden" in noted):
                for a, x, y, z, hidden in _ATTR.findall(noted):
                    attrs[(a or hidden).lower()] = x or y or z
            if tag in INLINE and not (attrs and _noisy(tag, attrs, True)):
                continue
            self._end_block()
            if tag in BLOCKS_END_P and self._open and self._open[-1][0] == "p":
                self._pop()
            for other in CLOSES.get(tag, "").split():
                if self._open and self._open[-1][0] == other:
                    self._pop()
            if tag == "body" and self._open and self._open[-1][0] == "head":
                self._pop()
            _, above, noise = self._open[-1] if self._open else ("", 0, False)
            token = self._token(above, tag, tag + "".join(f".{attrs[k]}" for k in ("id", "class") if attrs.get(k)))
            if tag not in VOID and not (noted or "").endswith("/"):
                noise = noise or tag == "head" or _noisy(tag, attrs, self._inside > 0)
                self._open.append((tag, token, noise))
                self._names[tag] += 1
                self._inside += tag in MAIN
        self._end_block()


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


_TOKENS = "host string, token long, kind int, depth int, pages long, times long, vector long, mass long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each (host, token) over the pages of a batch; token -1 counts the
    pages and the text outside noise."""
    for batch in batches:
        sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for host, page_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = Page(text)
            seed, mass = xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(str(page_id))), page.mass()
            said = Counter((token, said) for token, said, _ in page.blocks)
            found = [((host, page.key[t], page.kind[t], page.depth[t]), page.times[t], mass[t])
                     for t in range(1, len(page.key))]
            found += [((host, page.text_key(t, s), TEXT, page.depth[t] + 1), n, 0) for (t, s), n in said.items()]
            for key, n, m in [*found, ((host, -1, PART, 0), 1, mass[0])]:
                s = sums[key]
                s[0] += 1
                s[1] += n
                s[2] = (s[2] + xxhash.xxh64_intdigest(f"{seed} {n}")) & 0xFFFFFFFF
                s[3] += m
        rows = [(*k, *v) for k, v in sums.items()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                         ["host", "token", "kind", "depth", "pages", "times", "vector", "mass"])


def templates(pages: DataFrame) -> DataFrame:
    """host, slot (token of the article's frame), slot_kind, fixed (text tokens, on
    MIN_SHARE of the pages, so no more than a few pages hold): a row a host."""
    t = stored(pages.mapInArrow(_tokens, _TOKENS).groupBy("host", "token", "kind", "depth")
               .agg(*[F.sum(c).alias(c) for c in ("pages", "times", "vector", "mass")]), "html-tokens")
    all_pages = t.where(F.col("token") == -1).select(
        F.col("host").alias("of"), F.col("pages").alias("host_pages"), F.col("mass").alias("host_mass"))
    classes = (t.where(F.col("token") != -1).groupBy(F.col("host").alias("ch"), F.col("vector").alias("cv"),
                                                     F.col("pages").alias("cp"))
               .agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 2))
    valid = (t.where(F.col("token") != -1)
             .join(classes, (F.col("host") == F.col("ch")) & (F.col("vector") == F.col("cv"))
                   & (F.col("pages") == F.col("cp"))).drop("ch", "cv", "cp")
             .join(all_pages, F.col("host") == F.col("of")).drop("of")
             .where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("host_pages"))))
    once = (F.col("kind") == CONTAINER) & (F.col("times") == F.col("pages"))
    frame = ((once | (F.col("kind") == ARTICLE)) & (F.col("mass") >= MAIN_SHARE * F.col("host_mass"))
             & (F.col("mass") > 0))
    best = F.max_by(F.when(frame, F.struct("token", "kind")), F.when(frame, F.struct("depth", "mass", "token")))
    return stored(valid.groupBy("host").agg(
        best.alias("best"), F.collect_list(F.when(F.col("kind") == TEXT, F.col("token"))).alias("fixed"))
        .select("host", F.col("best.token").alias("slot"), F.col("best.kind").alias("slot_kind"), "fixed"), "html-templates")


def main_text(page: Page, slot: int | None, slot_kind: int | None, fixed: set[int]) -> str:
    """The article of a page, given its host's template."""
    framed = [k == slot for k in page.key] if slot is not None else []
    kind = slot_kind
    if not any(framed):  # no template, or a page without its slot
        framed, kind = [k == ARTICLE for k in page.kind], ARTICLE
        if not any(framed):
            framed, kind = [True] * len(page.key), CONTAINER
    within = page.inside(framed)
    inside = [(t, s) for t, s, noise in page.blocks if not noise and within[t]]
    if fixed and kind != ARTICLE:
        inside = [(t, s) for t, s in inside if page.text_key(t, s) not in fixed] or inside
    return " ".join(s for _, s in inside)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int | None, int | None, set[int]]] = {}
    for batch in batches:
        out = []
        for raw, host, slot, kind, fixed in zip(*(batch.column(c) for c in ("html", "host", "slot", "slot_kind", "fixed")),
                                                strict=True):
            if (name := host.as_py()) not in known:
                if len(known) > 1000:
                    known.clear()
                known[name] = (slot.as_py(), kind.as_py(), set(fixed.as_py() or ()))
            out.append(main_text(Page(raw.as_py()), *known[name]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
             pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    prepare(pages.sparkSession)
    rows = own_columns(pages, "page_id", "url", "html").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    t = templates(rows.select("host", F.col("page_id").cast("string"), "html")).withColumnRenamed("host", "of")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.join(t, F.col("host") == F.col("of"), "left").select(
        "page_id", "url", "html", "host", "slot", "slot_kind", "fixed").mapInArrow(
        _texts, f"page_id {kind}, url string, text string, n_chars long")
