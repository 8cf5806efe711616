"""Main text of web pages by markup and by a suffix array over the token streams of a host's pages.

A page is parsed in one pass to blocks of text. Markup says what it can: scripts, styles, forms, navigation, headers,
footers, asides and what a class, id or role names outright as a notice, advert, menu or comment is no main text; what
else stands in a declared article is. The rest is undecided: blocks with a label that only may mean boilerplate
("share-price" doesn't, "share-strip" does), and all blocks of pages that declare no article.

Undecided blocks are decided by repetition on their host. The streams of its pages (all text that is neither hidden nor
decided article text) are concatenated, task by task, and a suffix array (by prefix doubling) brings equal runs of words
together; runs of all tasks are merged by host and run. A run on pages of different content is boilerplate; a block that
such runs cover goes, unique runs stay. Suffixes are ordered as deep as the shortest run that counts, as every longer
repeat is covered by repeats of that length, and no deeper order changes what is covered. Whole hosts are compared, of any
size and however pages are dealt; no task holds a host. Equal pages count as one; what two pages share that differ anywhere is
repeated, so near copies of a page that declares no article lose what they share.

Repeats in decided article text are not taken out: there they are quotations and copies, not boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _WORD_STEPS, cut, forget, unused, window_hashes, with_results, word_hashes, word_spans

#: Words of the shortest run that counts; the part of a block's words that repeated runs must cover.
RUN_WORDS = 6
COVERED = 0.8
#: Bytes of repeated runs, by page, up to which they are broadcast; beyond, they are joined.
BROADCAST_BYTES = 32 << 20
#: Characters of pages whose streams are put in one suffix array.
STREAM_CHARS = 4 << 20

#: What a block is: main text, undecided, or neither (its words still count as repeats).
MAIN, OPEN, OTHER = 0, 1, 2

#: Elements whose content is no markup or no text, elements that are no main text, elements that end a
#: block, elements that hold an article, elements without an end.
_RAW = frozenset("script style textarea title noscript template iframe noframes noembed".split())
_ASIDE = frozenset("nav header footer aside form button dialog menu head fieldset".split())
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_ARTICLES = frozenset(("article", "main"))
_ITEMS = frozenset("li option tr td th dt dd".split())
#: Elements that may stand in a head, and those before which an open paragraph ends.
_HEAD = frozenset("base link meta title style script noscript template bgsound basefont".split())
_ENDS_P = _BLOCKS - frozenset("body br caption html legend option tbody td tfoot th thead title tr head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name something other than main text; those of them that, beside a word that isn't
#: neutral, may name something else ("share-price", "ad-hoc"); words that say nothing beside them.
_LABELS = frozenset("ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
_DOUBTFUL = frozenset("ad ads alert banner comment comments complementary consent footer header menu modal nav notice notices pager popup promo related replies share sharing sidebar signup social sponsor subscribe toolbar widget widgets".split())
_NEUTRAL = frozenset("area author bar bars block body bottom box button buttons center col column container content count date desktop dialog dropdown entry fixed foot footer form global group head header holder icon icons inner item items label large left lg link links list main md message meta mobile name outer page panel policy post posts primary reader right row secondary section site slot sm small space sticky strip tag text thread time title top unit user view wrap wrapper x xl xs".split())
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Za-z]+")


def attributes_of(text: str) -> dict[str, str]:
    """An element's attributes; of those named twice, the first."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), "".join(values))
    return found


def hidden(attributes: dict[str, str]) -> bool:
    """Whether an element says that it isn't shown."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_INVISIBLE.search(attributes.get("style", "")))


def label(attributes: dict[str, str]) -> int:
    """What an element's class, id and role say: OTHER if one of their words names boilerplate, OPEN if it may, else MAIN."""
    found = MAIN
    for word in " ".join(attributes.get(n, "") for n in ("class", "id", "role")).lower().split():
        parts = _PART.findall(word)
        if any(p in _LABELS for p in parts):
            if any(p in _LABELS and p not in _DOUBTFUL for p in parts) or all(p in _LABELS or p in _NEUTRAL for p in parts):
                return OTHER
            found = OPEN
    return found


class _Page:
    """One pass over a page; each character is looked at a bounded number of times, however broken the markup."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def tag_end(self, at: int) -> int:
        """Where the tag that is open at `at` ends, after its ">"; -1 if there is none. Quoted ">" don't count; once a
        quote is found to stay open to the end of the page, quotes are no longer heeded."""
        page, start = self.page, at
        while self.quotes:
            m = _STOP.search(page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            close = page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.quotes = False
        return page.find(">", start) + 1 or -1

    def blocks(self) -> list[tuple[str, int]]:
        """Blocks of text that isn't hidden, each with what it is."""
        page, n, at = self.page, len(self.page), 0
        out: list[tuple[str, int, bool]] = []
        text: list[str] = []
        stack: list[tuple[str, bool, bool, bool]] = []  # element, whether it hides, is an article, is in doubt
        held: Counter = Counter()
        open_blocks: list[str] = []  # of the stack, those that end a block
        hides = inside = doubts = 0

        def end_top() -> str:
            nonlocal hides, inside, doubts
            closed, hid, article, doubt = stack.pop()
            held[closed] -= 1
            hides -= hid
            inside -= article
            doubts -= doubt
            if closed in _BLOCKS:
                open_blocks.pop()
            return closed

        def flush():
            if text:
                words = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if words:
                    out.append((words, inside > 0, doubts > 0))

        while at < n:
            tag = page.find("<", at)
            if tag < 0:
                tag = n
            if tag > at and not hides:
                text.append(page[at:tag])
            if tag == n:
                break
            if page.startswith("<!--", tag):
                end = page.find("-->", tag + 4)
                at = end + 3 if end >= 0 else n
                continue
            if page.startswith("<![CDATA[", tag):
                end = page.find("]]>", tag)
                at = end + 3 if end >= 0 else n
                continue
            if page.startswith(("<!", "<?"), tag):
                at = page.find(">", tag) + 1 or n
                continue
            m = _NAME.match(page, tag)
            end = self.tag_end(m.end()) if m else -1
            if m is None or end < 0:
                if m is None:  # a stray "<"
                    if not hides:
                        text.append("<")
                    at = tag + 1
                else:  # a tag that the page's end cuts off
                    at = n
                continue
            attributes, at, name = page[m.end() : end - 1], end, m[2].lower()
            if name in _BLOCKS:
                flush()
            if m[1]:
                while held[name] and end_top() != name:
                    pass
                continue
            if held["head"] and name not in _HEAD:  # what can't stand in a head ends it
                while end_top() != "head":
                    pass
            # a paragraph ends before a block, an item before the next one, whatever inline elements are open in them
            if open_blocks and (open_blocks[-1] == "p" and name in _ENDS_P or open_blocks[-1] == name and name in _ITEMS):
                ending = open_blocks[-1]
                while end_top() != ending:
                    pass
            if name in _RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = (page.find(">", close.end() - 1) + 1 or n) if close else n
                continue
            if name in _VOID or attributes.endswith("/") and name not in _BLOCKS:
                continue
            hide, doubt = name in _ASIDE and not (name == "header" and inside), False
            if attributes:
                named = attributes_of(attributes)
                said = label(named) if inside or name not in ("html", "body", "article", "main") else MAIN
                if said == OTHER and name == "article" and not held["article"] and not all(w in _LABELS for w in named.get("class", "").lower().split()):
                    said = OPEN  # "post menu" in a main element may be the article itself
                hide = hide or said == OTHER or hidden(named)
                doubt = said == OPEN
            article = name in _ARTICLES
            stack.append((name, hide, article, doubt))
            if name in _BLOCKS:
                open_blocks.append(name)
            held[name] += 1
            hides += hide
            inside += article
            doubts += doubt
        flush()
        declared = any(b[1] for b in out)
        return [(words, (OPEN if doubt else MAIN) if within else OTHER if declared else OPEN) for words, within, doubt in out]


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Blocks of a page: (text, MAIN, OPEN or OTHER). A null page has none."""
    return _Page(page).blocks() if page else []


def _stream(page: list[tuple[str, int]]) -> np.ndarray:
    """Hashes of the words of what a page has besides decided main text, in order."""
    data = np.frombuffer(" ".join(t for t, kind in page if kind != MAIN).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def suffix_order(words: np.ndarray, page: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a stream of words from which a run of `size` words of one page starts, in the order of their suffixes,
    and the bounds of those with equal runs.

    Prefix doubling ranks the suffixes by their first 1, 2, 4, ... words, as deep as size.
    """
    n = len(words)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, rank = np.unique(words, return_inverse=True)
    depth = 1
    while depth < size:
        step = min(depth, size - depth)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        depth += step
    at = np.flatnonzero(page[: n - size + 1] == page[size - 1 :])
    order = at[np.argsort(rank[at], kind="stable")]
    bounds = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
    return order, bounds


def repeated_in(streams: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of some pages of one host, by a suffix array over their streams: the hash of each run, and the
    least and the greatest content of the pages that have it."""
    words = np.concatenate([*streams, np.zeros(0, np.uint64)])
    page = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    order, bounds = suffix_order(words, page, size)
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = window_hashes(words, _WORD_STEPS[0], order, size)
    content = np.array([_content(x) for x in streams], np.int64)
    own = content[page[order]]
    return hashes[bounds[:-1]].view(np.int64), np.minimum.reduceat(own, bounds[:-1]), np.maximum.reduceat(own, bounds[:-1])


def _content(words: np.ndarray) -> int:
    """A number for all that a page says, whatever part of it other pages share."""
    return int(window_hashes(words, _WORD_STEPS[1], np.zeros(1, np.int64), len(words)).view(np.int64)[0]) if len(words) else 0


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(max(0, len(words) - size + 1))
    return window_hashes(words, _WORD_STEPS[0], at, size).view(np.int64)


def main_text(page: list[tuple[str, int]], repeated: np.ndarray, size: int = RUN_WORDS, covered: float = COVERED) -> str:
    """A page's main text: its main blocks, and those undecided ones that the repeated runs (hashes) don't cover."""
    words = _stream(page) if len(repeated) else np.zeros(0, np.uint64)
    hit = np.isin(_runs(words, size), repeated) if len(words) else np.zeros(0, bool)
    step = np.zeros(len(words) + 1, np.int64)
    step[: len(hit)] += hit
    step[size : size + len(hit)] -= hit
    seen = np.cumsum(step[:-1]) > 0
    out, at = [], 0
    for text, kind in page:
        if kind != MAIN and len(words):
            n = len(text.split(" "))
            gone = seen[at : at + n].mean() >= covered
            at += n
        else:
            gone = False
        if kind == MAIN or kind == OPEN and not gone:
            out.append(text)
    return "\n".join(out)


def _evidence(size: int):
    """Rows (host, html) to rows (host, run, least, most)."""

    def rows(held):
        for host, streams in held.items():
            runs, least, most = repeated_in(streams, size)
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(runs), pa.string()), pa.array(runs), pa.array(least), pa.array(most)], ["host", "run", "least", "most"])

    def run(batches):
        forget()
        held, chars = {}, 0
        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1)):
                page = page.as_py() or ""
                held.setdefault(host.as_py(), []).append(_stream(blocks(page)))
                chars += len(page)
                if chars > STREAM_CHARS:
                    yield from rows(held)
                    held, chars = {}, 0
        yield from rows(held)

    return run


def _own_runs(size: int):
    """Rows (host, key, html) to rows (host, key, run) of the pages with undecided blocks."""

    def run(batches):
        forget()
        for batch in batches:
            for host, key, page in zip(batch.column(0), batch.column(1), batch.column(2)):
                parsed = blocks(page.as_py())
                if any(kind == OPEN for _, kind in parsed):
                    runs = np.unique(_runs(_stream(parsed), size))
                    yield pa.RecordBatch.from_arrays([pa.array([host.as_py()] * len(runs), pa.string()), pa.array([key.as_py()] * len(runs), pa.int64()), pa.array(runs)], ["host", "key", "run"])

    return run


@F.arrow_udf(T.BooleanType())
def _undecided(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    forget()
    for batch in pages:
        yield pa.array([any(kind == OPEN for _, kind in blocks(x.as_py())) for x in batch], pa.bool_())


def host_of(url: Column) -> Column:
    """The host in a url, in lower case; an empty text for null or without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def repeated_runs(pages: DataFrame, size: int = RUN_WORDS) -> DataFrame | None:
    """(key, runs): for pages (host, key, html) with undecided blocks, the runs of theirs that are boilerplate on their
    host, packed as 64-bit hashes. None if no page is undecided."""
    hosts = cut(pages.where(_undecided("html")).select("host").distinct())
    if not hosts.limit(1).count():
        return None
    known = pages.join(hosts, "host", "left_semi")
    found = known.select("host", "html").mapInArrow(_evidence(size), "host string, run long, least long, most long")
    found = found.groupBy("host", "run").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("host", "run")
    own = known.select("host", "key", "html").mapInArrow(_own_runs(size), "host string, key long, run long")
    return cut(own.join(found, ["host", "run"]).groupBy("key").agg(F.collect_set("run").alias("runs")))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", size: int = RUN_WORDS) -> DataFrame:
    """pages, without the html, with text (empty if there is none) and n_chars (its code points), a row a row.

    A null html is an empty page. Pages whose url is null or has no host are one more host. Equal pages get equal texts
    and count as one, so repeated rows change nothing. Broken markup is read as far as it goes: a head ends at the first element
    that can't stand in one, a paragraph before a block, other elements that are not closed with those around them; a quote that is
    never closed is none. Pages may be of
    any length. Columns named like a result are replaced, all others stay. An empty table gives an empty table.
    """
    keep = [c for c in pages.columns if c != html_col]
    key, runs = unused(pages, "key", "runs")
    keyed = pages.withColumn(key, F.xxhash64(url_col, html_col))
    hits = repeated_runs(keyed.select(host_of(F.col(url_col)).alias("host"), F.col(key).alias("key"), F.col(html_col).alias("html")), size)
    if hits is None:
        keyed = keyed.withColumn(runs, F.lit(None).cast("array<bigint>"))
    else:
        bytes_ = hits.agg(F.sum(F.size("runs") * 8 + 64)).first()[0] or 0
        hits = hits.select(F.col("key").alias(key), F.col("runs").alias(runs))
        keyed = keyed.join(F.broadcast(hits) if bytes_ <= BROADCAST_BYTES else hits, key, "left")

    @F.arrow_udf("string")
    def text(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        forget()
        for html_, own in columns:
            yield pa.array([main_text(blocks(x.as_py()), np.array(r.as_py() or [], np.int64), size) for x, r in zip(html_, own)], pa.string())

    out = with_results(keyed, text=text(F.col(f"`{html_col}`"), F.col(runs)))
    return with_results(out.select(*(f"`{c}`" for c in keep if c.lower() not in ("text", "n_chars")), "text"), n_chars=F.char_length("text").cast("long"))
