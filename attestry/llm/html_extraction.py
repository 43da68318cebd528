"""Main text of web pages: a suffix array of each host finds what its pages repeat, markup tells what blocks are.

A page is cut into blocks. Blocks in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are
boilerplate by their markup. The others belong to an article or are open. The token streams of all blocks of a page, of
whatever kind, are put together, and those of a host make one suffix array. Suffixes that share LEAST or more tokens
with another page's are long repeats, and the tokens they share are covered. Covered tokens of open blocks are
boilerplate; those of articles are if half of the host's pages repeat them, as articles may quote each other. A repeat
may go on over the end of a block: of a block that it doesn't cover wholly, it takes LEAST tokens or nothing.
What stays are the unique runs. A page that would lose most of its text is a copy of another page, and keeps it.

The array is built in shuffles, and only where repeats are: a repeat of LEAST tokens holds WINDOW runs of DEPTH tokens, of
which that with the smallest hash, the anchor, is the same wherever the repeat stands. Anchors that one page alone
has are sorted out; the suffixes that begin up to WINDOW tokens before the others are sorted by host and tokens, those
of equal beginning once, and each is compared with its neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import chunked, cut_lineage, mix

#: Tokens of a run whose hash makes an anchor, runs of which one is an anchor, and what follows: the least length of a repeat.
DEPTH, WINDOW = 6, 7
LEAST = DEPTH + WINDOW - 1
#: Tokens of a suffix that are compared. Longer repeats are covered by the suffixes that begin within them.
COMPARED = 16
#: An article's repeats are boilerplate if so many pages have them, and so large a share of the host's pages.
ARTICLE_PAGES, ARTICLE_SHARE = 5, 0.5
#: The share of a page's text that boilerplate is at most; a page with more of it is a copy.
MOST_REMOVED = 0.8
#: A side of at most so many keys or spans (some 16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A side of at most so many single keys (8 bytes each) is broadcast.
BROADCAST_KEYS = 1_000_000

# Kinds of elements.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody tfoot thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form dialog menu search head noscript template object svg canvas audio video button select datalist math map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr "
    "notice notices alert notification newsletter subscribe subscription signup login modal popup overlay nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget widgets footer header masthead share sharing social related recommended recommendations "
    "comment comments disqus replies respond pagination pager toolbar search skip".split()
)
#: Words that say where or in what form something stands; a class or id is boilerplate's if all its words are these or NAMES.
PLACES = frozenset(
    "site page global main primary secondary top bottom left right inner outer upper lower fixed sticky floating mobile desktop box bar block "
    "container wrapper wrap area section zone slot unit panel col column row list item items link links button buttons btn icon icons form "
    "header footer text title label content group image img js ui c m l s xs sm md lg xl".split()
) - frozenset(["content", "text", "title", "page"])
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

ARTICLE, OPEN, BOILERPLATE = 0, 1, 2
#: Boilerplate that stands as a block or within one: blocks inside the latter don't end the block around it.
OUTSIDE, WITHIN = 1, 2


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def _boilerplate(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element and all in it is no content. in_article says whether it stands in an article or the main element."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes:
        return False
    role = attributes.get("role", "").lower()
    if role in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    if name in ("html", "body", "main", "article") and "comment" not in attributes.get("class", "").lower():
        return False
    for named in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [p.lower() for p in _NAME_PARTS.findall(named)]
        own_header = "header" in parts and (in_article or parts[0] in ("article", "post", "entry", "content", "page"))
        # one word of several, as in related-work, says nothing: the host's pages decide
        if all(p in NAMES or p in PLACES for p in parts) and any(p in NAMES and not (p == "header" and own_header) for p in parts):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """The blocks of a page in order: text with single spaces, and whether it is the article's, open or boilerplate.

    A page without an article takes its main element for it. A boilerplate element within a block, as a link to share in a
    sentence, doesn't end the block: its text is a block of its own after it.
    """
    # open elements: name, in boilerplate (OUTSIDE, WITHIN), in an article, in main; where those of a name stand, and the block elements
    stack: list[tuple[str, int, bool, bool]] = []
    of_name: dict[str, list[int]] = {}
    of_block: list[int] = []
    drop, article, main = 0, False, False
    found: list[tuple[str, bool, bool, bool]] = []
    kept: list[str] = []
    lost: list[str] = []
    at, size = 0, len(page)

    def add(text: str) -> None:
        (lost if drop else kept).append(text)

    def flush(state: int) -> None:
        for buffer, out in ((kept, False), (lost, True)):
            if buffer and (out or state != WITHIN):
                text = " ".join(entities.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    found.append((text, out, article, main))

    def close(depth: int) -> None:
        nonlocal drop, article, main
        while len(stack) > depth:
            name = stack.pop()[0]
            of_name[name].pop()
            if name in BLOCK:
                of_block.pop()
        _, drop, article, main = stack[-1] if stack else ("", 0, False, False)

    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        token = _TOKEN.match(page, start)
        if token is None:  # a lone sign, or a tag that the page's end cuts off
            if re.match(r"</?[a-zA-Z]", page[start : start + 3]) and page.find(">", start) < 0:
                break
            add("<")
            at = start + 1
            continue
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["end"]:
            depth = of_name[name][-1] if of_name.get(name) else len(stack)
            if name in BLOCK:  # what is open within it ends as well
                flush(stack[depth - 1][1] if 0 < depth < len(stack) else drop if depth else 0)
            close(depth)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else size
            continue
        if name in VOID:
            if name == "hr":
                flush(drop)
            add(" ")
            continue
        if name in ("td", "th"):
            add(" ")
        if name in BLOCK:
            flush(drop)
            while stack and stack[-1][0] in CLOSED_BY and name in CLOSED_BY[stack[-1][0]]:
                close(len(stack) - 1)
            # a paragraph with open inline elements ends as well, but for those that hold blocks of their own
            if of_block and stack[of_block[-1]][0] == "p" and not (drop == WITHIN and any(of_name.get(n) and of_name[n][-1] > of_block[-1] for n in DROPPED)):
                close(of_block[-1])
            flush(drop)
        if token["rest"].endswith("/") and name not in BLOCK:
            continue
        attributes = _attributes(token["rest"]) if len(token["rest"]) > 1 else {}
        dropped = drop or (_boilerplate(name, attributes, article or main) and (OUTSIDE if name in BLOCK else WITHIN))
        inside = article or name == "article" or attributes.get("role") == "article" or "articlebody" in attributes.get("itemprop", "").lower()
        of_name.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            of_block.append(len(stack))
        stack.append((name, dropped, inside, main or name == "main" or attributes.get("role") == "main"))
        _, drop, article, main = stack[-1]
    flush(0)
    by_article = any(a and not d for _, d, a, _ in found)
    by_main = not by_article and any(m and not d for _, d, _, m in found)
    return [(t, BOILERPLATE if d else ARTICLE if (a and by_article) or (m and by_main) else BOILERPLATE if by_article or by_main else OPEN) for t, d, a, m in found]


def stream(found: list[tuple[str, int]]) -> np.ndarray:
    """A code of each token (in lower case) of the blocks of a page, in order, with a 0 after each block."""
    digest, codes = xxhash.xxh32_intdigest, []
    for text, _ in found:
        codes += [digest(w) | 1 for w in text.lower().split()]
        codes.append(0)
    return np.array(codes, np.uint32)


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a stream's anchors, and the hashes of their runs."""
    if len(codes) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = np.zeros(len(codes) - DEPTH + 1, np.uint64)
    for k in range(DEPTH):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(runs)]
    runs = mix(runs)
    least = np.lib.stride_tricks.sliding_window_view(runs, WINDOW).argmin(axis=1)
    places = np.unique(least + np.arange(len(least)))
    return places, runs[places]


_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), _HOST, 1)), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), text.alias("html"), F.xxhash64(text).alias("page_key"))


def _anchored(rows: DataFrame, context: bool) -> DataFrame:
    """(anchor, page) of each page's anchors; with context also host, id, page_key, pos, before and tokens.

    anchor is a hash of the host and the run, page one of the stream, so pages of the same tokens are one. tokens (four
    bytes each, in an order that sorts) begin at pos, `before` tokens ahead of the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "html"):
            keys, pages, of, starts, befores, tokens = [], [], [], [], [], []
            for row, (host, page) in enumerate(zip(batch.column("host").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("html").to_pylist(), strict=True)):
                codes = stream(blocks(page))
                places, runs = anchors(codes)
                own = mix(runs + host).view(np.int64)
                if not context:
                    own = np.unique(own)
                keys.append(own)
                pages.append(np.full(len(own), np.uint32(xxhash.xxh32_intdigest(codes.tobytes()))).view(np.int32))
                if context:
                    data = codes.astype(">u4").tobytes()
                    begin = np.maximum(places - WINDOW + 1, 0)
                    of += [row] * len(places)
                    starts.append(begin)
                    befores.append(places - begin)
                    tokens += [data[4 * b : 4 * (p + COMPARED)] for b, p in zip(begin.tolist(), places.tolist(), strict=True)]
            flat = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.empty(0, t))
            columns, names = [flat(keys, np.int64), flat(pages, np.int32)], ["anchor", "page"]
            if context:
                where = pa.array(of, pa.int64())
                columns += [*(batch.column(c).take(where) for c in ("host", "id", "page_key")), flat(starts, np.int32), flat(befores, np.int32), pa.array(tokens, pa.binary())]
                names += ["host", "id", "page_key", "pos", "before", "tokens"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "anchor long, page int" + (", host long, id long, page_key long, pos int, before int, tokens binary" if context else "")
    return rows.select("id", F.xxhash64("host").alias("host"), "html", "page_key").mapInArrow(run, schema)


def _common(a: bytes, b: bytes) -> int:
    """Tokens that two suffixes begin with in common."""
    n = min(len(a), len(b)) // 4
    x, y = np.frombuffer(a, np.uint32, n), np.frombuffer(b, np.uint32, n)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def _neighbours(suffixes: DataFrame) -> DataFrame:
    """(begin, key, length) of suffixes(begin, suffix, key, first, last), sorted by begin and suffix; key is a hash of the suffix.

    length is how many tokens a suffix has in common with a neighbour of another page, LEAST at least: the suffixes of one
    begin all share so many. first and last are the smallest and largest page that has the suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, and its length so far

        def made(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r, _ in out], pa.int64()) for k in (0, 4)] + [pa.array([n for _, n in out], pa.int32())], ["begin", "key", "length"])

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("begin", "suffix", "first", "last", "key")), strict=True):
                length = LEAST if row[2] == row[3] else len(row[1]) // 4
                if held is not None:
                    before, least = held
                    if before[0] == row[0] and not before[2] == before[3] == row[2] == row[3]:
                        shared = _common(before[1], row[1])
                        length, least = max(length, shared), max(least, shared)
                    out.append((before, least))
                held = row, length
            yield made(out)
        if held is not None:
            yield made([held])

    return suffixes.select("begin", "suffix", "first", "last", F.xxhash64("suffix").alias("key")).mapInArrow(run, "begin long, key long, length int")


def _checked(small: DataFrame, size=None, most: int = BROADCAST_ROWS) -> DataFrame:
    """small, to be broadcast if it has few rows, or few entries where size counts them."""
    if size is None:
        few = small.limit(most + 1).count() <= most
    else:
        few = small.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_ROWS
    return F.broadcast(small) if few else small


def repeats(rows: DataFrame) -> DataFrame:
    """(id, page_key, spans) of pages with long repeats: spans holds pos, length and pages of each, and how many the host has."""
    shared = cut_lineage(_anchored(rows, False).groupBy("anchor").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first <> last").select("anchor"))
    if shared.isEmpty():
        return rows.sparkSession.createDataFrame([], "id long, page_key long, spans array<struct<pos: int, length: int, pages: long, of: long>>")
    around = cut_lineage(_anchored(rows, True).join(_checked(shared, most=BROADCAST_KEYS), "anchor", "left_semi").drop("anchor"))
    begun = around.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("before"))))
    suffix, first = F.expr(f"substring(tokens, 4 * k + 1, {4 * COMPARED})"), F.expr(f"substring(tokens, 4 * k + 1, {4 * LEAST})")
    # begin is a hash of the host and the first LEAST tokens
    suffixes = begun.select("host", "page", "id", "page_key", (F.col("pos") + F.col("k")).alias("pos"), F.xxhash64("host", first).alias("begin"), suffix.alias("suffix")).where(F.length("suffix") >= 4 * LEAST)
    each = suffixes.groupBy("begin", "page").agg(F.lit(1)).groupBy("begin").agg(F.count("*").alias("pages")).where("pages > 1")
    long = _checked(cut_lineage(each))
    sorted_ = suffixes.join(long, "begin", "left_semi").groupBy("begin", "suffix").agg(F.min("page").alias("first"), F.max("page").alias("last")).repartition("begin").sortWithinPartitions("begin", "suffix")
    lengths = cut_lineage(_neighbours(sorted_))
    size = rows.select(F.xxhash64("host").alias("host"), "page_key").groupBy("host").agg(F.count_distinct("page_key").alias("of"))
    placed = suffixes.join(long, "begin").select("host", "id", "page_key", "pos", "begin", "pages", F.xxhash64("suffix").alias("key"))
    found = placed.join(_checked(lengths), ["begin", "key"]).join(_checked(cut_lineage(size)), "host")
    return found.groupBy("id", "page_key").agg(F.collect_set(F.struct("pos", "length", "pages", "of")).alias("spans"))


def long_runs(covered: np.ndarray) -> np.ndarray:
    """covered without its runs of fewer than LEAST, unless all is covered."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
    out = covered.copy()
    for start, stop in edges.reshape(-1, 2).tolist():
        if stop - start < LEAST and stop - start < len(covered):
            out[start:stop] = False
    return out


def page_text(page: str, spans: list[tuple[int, int, int, int]]) -> str:
    """The blocks of a page without boilerplate. spans: where repeats begin, their length, and the pages that have them of all the host's."""
    found = blocks(page)
    size = sum(len(text.split()) + 1 for text, _ in found) if spans else 0
    marks = np.zeros((2, size + 1), np.int32)
    for pos, length, pages, of in spans:
        for row in (0, 1) if pages >= max(ARTICLE_PAGES, ARTICLE_SHARE * of) else (0,):
            marks[row, pos] += 1
            marks[row, pos + length] -= 1
    covered = {OPEN: np.cumsum(marks[0]) > 0, ARTICLE: np.cumsum(marks[1]) > 0}
    kept, at, words_of, left = [], 0, 0, 0
    for text, kind in found:
        if kind == BOILERPLATE:
            at += len(text.split()) + 1 if spans else 0
            continue
        words = text.split()
        gone = long_runs(covered[kind][at : at + len(words)]) if spans else np.zeros(len(words), bool)
        kept.append((text, text if not gone.any() else " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
        at, words_of, left = at + len(words) + 1, words_of + len(words), left + len(words) - int(gone.sum())
    copy = left < (1 - MOST_REMOVED) * words_of
    return "\n".join(filter(None, (whole if copy else rest for whole, rest in kept)))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row: blocks of main text joined by a line feed, and the code points.

    A null or empty page, and one without main text, has the empty text. Null urls, and urls without a host, are one host
    of their own. Rows of one id and html come back each, with one text; null ids too. Pages of the same tokens count as
    one page for repeats. Other columns are ignored; an empty table gives none.
    """
    rows = _rows(pages, id_col, url_col, html_col)
    covered = cut_lineage(repeats(rows).select(F.col("id").alias("id2"), F.col("page_key").alias("key2"), "spans"))
    small = _checked(covered, F.size("spans"))
    joined = rows.join(small, F.col("id").eqNullSafe(F.col("id2")) & (F.col("page_key") == F.col("key2")), "left").select("id", "url", "html", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "html"):
            marked = [[(c["pos"], c["length"], c["pages"], c["of"]) for c in x or ()] for x in batch.column("spans").to_pylist()]
            texts = pa.array([page_text(h, c) for h, c in zip(batch.column("html").to_pylist(), marked, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), texts, pc.utf8_length(texts).cast(pa.int64())], ["id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "id long, url string, text string, n_chars long")
