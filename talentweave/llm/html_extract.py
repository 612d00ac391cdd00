"""Main text of web pages: host suffix arrays find repeated runs, with markup roles as the prior.

A page is read as a stream of tags and text into blocks with a role from markup: menus, page headers, footers,
sidebars, notices, adverts, scripts, styles and reader comments are chrome; what stands inside an article or main
element is content; the rest is open. Neither the html and body elements nor a form or wrapper around an article
(`content-with-sidebar`) make an article chrome; a form that holds most of a page without any article is open.

For each host the token streams of all its pages' blocks are concatenated and sorted by suffix, down to the first RUN
tokens, by prefix doubling; runs of RUN tokens or more that occur on distinct pages are repeated, whatever their length.

- Of an open block the repeated runs go and the unique runs stay: what is left has RUN tokens at least where something
  was cut. Blocks shorter than a run cannot be judged by runs: they stay on pages without content by markup only.
- Content stays, since whole articles are copied on a host and passages recur, unless it is the site's: a block of RUN
  words or more that stands as a whole on at least half of the host's pages, MOST_PAGES or more, goes from an article
  most of whose words are not in such blocks.
- Chrome is never text; its runs are evidence against open blocks.
- Inside content a class or id marks chrome only if all its words do (`ad-slot`, but not `related-work`). An open h1
  before content without one is its headline. A wrapper or form that holds most of a page without content is open.

A host with more text than a group may hold is dealt by page into groups of bounded size, so that no task gathers a
hot host. Each group has its own array; what groups cannot see alone is aggregated over the host by 64-bit hashes and
handed to the groups: the site's blocks, and on hosts with open blocks that runs can judge the runs that are repeated.
Hosts of one group go the same way: the text of a page depends neither on how its host was dealt nor on its size.
Partitions follow the bytes.

Null html counts as empty and gives an empty text; null urls share a group of their own; repeated rows stay and, being
one page, do not make their own text repeated when their page id is equal. Extra columns are dropped, whatever their
names: the result is (page_id, url, text, n_chars), a row for each row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import cut

#: Tokens of the shortest run that counts as repeated; the share of a short open block that is repeated when it goes; the
#: least number of pages that make a block the site's.
RUN, COVERED, MOST_PAGES = 8, 0.5, 3
#: UTF-8 bytes of html in one group of a host's pages, and in one partition, about.
GROUP_BYTES, PARTITION_BYTES = 500_000, 32_000_000
#: Hosts that may be broadcast; more of them are joined by a shuffle that AQE can split.
MOST_HOSTS = 50_000

CONTENT, OPEN, CHROME, FORM, WRAPPER, HEADLINE = range(6)
#: The roles of elements, and words of class, id and role attributes that mark chrome.
CONTENT_TAGS = frozenset("article main".split())
CHROME_TAGS = frozenset("nav aside footer menu dialog head title button select datalist object canvas audio video map fieldset".split())
RAW_TAGS = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "xmp", "noframes", "noembed")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSED_BY_BLOCK = frozenset(("p",))
SELF_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu sidebar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe share sharing social related recommended comment comments disqus breadcrumb breadcrumbs pagination pager".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
WRAPPER_WORDS = frozenset("has with no without content main page wrap wrapper layout container body article post entry".split())
#: Words that a name of chrome inside content may have beside those that mark it.
CHROME_PARTS = frozenset("area articles bar block body box button buttons container count feed footer form group head header icon icons inner item items label link links list module panel posts row section signup slot stories text thread title top bottom left right unit widget wrap wrapper".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW_TAGS}
_PARTS = re.compile(r"[\s_-]+")


def _marked(attributes: str, inside_content: bool) -> int:
    """The role that an element's attributes give: chrome, wrapper (chrome but for articles in it) or open."""
    found = OPEN
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return CHROME
        if name == "role":
            if value in CHROME_ROLES:
                return CHROME
        elif name in ("class", "id"):
            for token in value.split():
                words = set(_PARTS.split(token))
                if inside_content:
                    if words & CHROME_WORDS and all(w in CHROME_WORDS or w in CHROME_PARTS or w.isdigit() for w in words):
                        return CHROME
                elif words & CHROME_WORDS or words & HEADER_WORDS:
                    if not words & WRAPPER_WORDS:
                        return CHROME
                    found = WRAPPER
    return found


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """(role, text) of each block that has text, in page order. White space in a block is one space."""
    html = html or ""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that may hold blocks or change the role, with the role inside
    count: dict[str, int] = {}  # how often each is open, so that a stray end tag costs nothing
    role, headed = OPEN, False  # headed: an h1 inside content

    def flush() -> None:
        if text:
            if body := " ".join(unescape("".join(text)).split()):
                out.append((role, body))
            text.clear()

    def close(at: int) -> None:
        nonlocal role
        flush()
        for tag, _ in stack[at:]:
            count[tag] -= 1
        del stack[at:]
        role = stack[-1][1] if stack else OPEN

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if count.get(tag):
                close(max(i for i in range(len(stack)) if stack[i][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag in _RAW_END:
            over = _RAW_END[tag].search(html, at)
            at = over.end() if over else end
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
            if stack and stack[-1][0] in CLOSED_BY_BLOCK:
                close(len(stack) - 1)
            if (siblings := SELF_SIBLING.get(tag)) and stack and stack[-1][0] in siblings:
                close(len(stack) - 1)
        if tag in VOID_TAGS:
            continue
        inner = role
        headed = headed or (role == CONTENT and tag == "h1")
        if role != CHROME:
            marked = _marked(m[3], role == CONTENT) if m[3] and tag not in ("html", "body") else OPEN
            if tag in CHROME_TAGS or (tag == "header" and role != CONTENT) or marked == CHROME or (role == CONTENT and (marked == WRAPPER or tag == "form")):
                inner = CHROME
            elif tag in CONTENT_TAGS:
                inner = CONTENT
            elif role == OPEN and (tag == "form" or marked == WRAPPER):
                inner = FORM if tag == "form" else WRAPPER
            elif role == OPEN and tag == "h1":
                inner = HEADLINE
        if block or inner != role:
            if not block:
                flush()
            stack.append((tag, inner))
            count[tag] = count.get(tag, 0) + 1
            role = inner
    flush()
    # A form or wrapper around most of a page without content is the page's own.
    sizes = [sum(len(t) for r, t in out if r == k) for k in range(6)]
    known = {k: OPEN if not sizes[CONTENT] and 2 * sizes[k] > sum(sizes) else CHROME for k in (FORM, WRAPPER)}
    start = next((i for i, (r, _) in enumerate(out) if r == CONTENT), 0)
    titled = CONTENT if not headed else OPEN
    return [(known.get(r, (titled if i < start else OPEN) if r == HEADLINE else r), t) for i, (r, t) in enumerate(out)]


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN, least: tuple[int, ...] = (2,), row: np.ndarray | None = None) -> list[np.ndarray]:
    """For each number in `least`: which tokens are in a run of `run` or more tokens that occurs on so many distinct
    pages. Tokens are numbers from 1.

    rank is the order of suffixes by their first k tokens; doubling k gives the suffix array's order to the depth that
    tells runs apart. A run ends at its page's end; at its row's, where rows of one page are told apart.
    """
    n, row = len(tokens), page if row is None else row
    if n < run:
        return [np.zeros(n, bool) for _ in least]
    last = np.append(np.flatnonzero(row[1:] != row[:-1]), n - 1)
    room = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1  # tokens to the row's end
    rank, k = tokens.astype(np.int64), 1
    while k < run:
        step = min(k, run - k)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        after[room <= step] = 0
        rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        k += step
    start = np.flatnonzero(room >= run)
    if not len(start):
        return [np.zeros(n, bool) for _ in least]
    order = start[np.lexsort((page[start], rank[start]))]
    first = np.append(True, rank[order][1:] != rank[order][:-1])
    edge = np.flatnonzero(first)
    pages = np.add.reduceat(first | np.append(True, page[order][1:] != page[order][:-1]), edge, dtype=np.int64)
    pages = np.repeat(pages, np.diff(np.append(edge, len(order))))
    out = []
    for limit in least:
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, order[pages >= limit], 1)
        np.add.at(depth, np.minimum(order[pages >= limit] + run, n), -1)
        out.append(np.cumsum(depth)[:n] > 0)
    return out


def stream_of(pages: list[tuple[object, list[tuple[int, str]]]]) -> tuple[list[str], np.ndarray, list[list[tuple[int, int]]]]:
    """The words of the blocks of pages (id, blocks) end to end, each word's page by number (equal ids are one page),
    and of each page's blocks the first word and the end."""
    ids: dict[object, int] = {}
    words, page, where = [], [], []
    for key, blocks in pages:
        own = ids.setdefault(key, len(ids))
        where.append([])
        for _, t in blocks:
            found = t.lower().split(" ")
            where[-1].append((len(words), len(words) + len(found)))
            words += found
            page += [own] * len(found)
    return words, np.array(page, np.int64), where


def run_hashes(words: list[str], run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the run that begins at each word; those that a stream's end cuts short are left out."""
    known: dict[str, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    own = np.array([known[w] for w in words], np.uint64)
    out = np.zeros(max(0, len(words) - run + 1), np.uint64)
    for j in range(run if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[j : j + len(out)]
    return out.view(np.int64)


def block_hashes(blocks: list[tuple[int, str]]) -> list[int | None]:
    """A signed 64-bit hash of each content block of RUN words or more, whatever its case; None for the others."""
    unsigned = [xxhash.xxh64_intdigest(t.lower()) if r == CONTENT and t.count(" ") >= RUN - 1 else None for r, t in blocks]
    return [h if h is None or h < 1 << 63 else h - (1 << 64) for h in unsigned]


def _site(pages: list[tuple[object, list[tuple[int, str]]]]) -> set[int]:
    """Hashes of the blocks on at least half of the pages, MOST_PAGES or more; equal ids are one page."""
    seen: dict[int, set] = {}
    for key, blocks in pages:
        for h in block_hashes(blocks):
            if h is not None:
                seen.setdefault(h, set()).add(key)
    most = max(MOST_PAGES, -(-len({key for key, _ in pages}) // 2))
    return {h for h, keys in seen.items() if len(keys) >= most}


def _finish(blocks: list[tuple[int, str]], where: list[tuple[int, int]], twice: np.ndarray, site: set[int]) -> str:
    """A page's main text. twice: which words are in runs on two pages; site: hashes of the blocks that are the site's."""
    own = [(b - a, h in site) for (r, _), (a, b), h in zip(blocks, where, block_hashes(blocks), strict=True) if r == CONTENT]
    mine = 2 * sum(n for n, of_site in own if of_site) < sum(n for n, _ in own)
    out, content = [], iter(own)
    for (r, t), (a, b) in zip(blocks, where, strict=True):
        if r == CONTENT:
            if not (next(content)[1] and mine):
                out.append(t)
        elif r == OPEN and b - a < RUN:
            if not own and twice[a:b].sum() < COVERED * (b - a):
                out.append(t)
        elif r == OPEN:
            kept = np.ones(b - a, bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], twice[a:b].view(np.int8), [0]])))
            for x, y in zip(edge[::2], edge[1::2], strict=True):
                # Shorter stretches are the ends of runs that began in other blocks.
                kept[x:y] = y - x < RUN
            if kept.all():
                out.append(t)
            elif kept.sum() >= RUN:
                out.append(" ".join(w for w, k in zip(t.split(" "), kept, strict=True) if k))
    return "\n\n".join(out)


def texts_of(pages: list[tuple[object, list[tuple[int, str]]]], elsewhere: np.ndarray | None = None, site: set[int] | None = None) -> list[str]:
    """Main texts of one group's pages (id, blocks). elsewhere: hashes of runs that are repeated on the host; site: hashes
    of the site's blocks, where the pages are not the whole host."""
    words, page, where = stream_of(pages)
    row = np.repeat(np.arange(len(pages)), [sum(b - a for a, b in own) for own in where])
    number: dict[str, int] = {}
    (twice,) = repeated(np.array([number.setdefault(w, len(number) + 1) for w in words], np.int64), page, RUN, row=row)
    site = _site(pages) if site is None else site
    if elsewhere is not None and len(elsewhere) and len(words) >= RUN:
        at = np.flatnonzero(np.isin(run_hashes(words), elsewhere) & (row[: len(words) - RUN + 1] == row[RUN - 1 :]))
        for j in range(RUN):
            twice[at + j] = True
    return [_finish(blocks, own, twice, site) for (_, blocks), own in zip(pages, where, strict=True)]


def _rows(group: pd.DataFrame) -> list[tuple[object, list[tuple[int, str]]]]:
    return [(k, list(zip(r, b, strict=True))) for k, r, b in zip(group["id"], group["roles"], group["blocks"], strict=True)]


def _on_host(parsed: DataFrame) -> DataFrame:
    """(host, block, n, asks) of all hosts: on how many pages each content block stands. The row with a null block counts
    the host's pages and tells whether an open block asks for runs: one of a run's length, or any on a page without content.

    Pages are counted by (host, block, page), then by (host, block), so that a block on every page gathers nowhere.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[tuple, None] = {}
            for host, page, roles, blocks in zip(*(b.column(c).to_pylist() for c in ("host", "page", "roles", "blocks")), strict=True):
                own = list(zip(roles, blocks, strict=True))
                rows[host, None, page] = None
                rows |= {(host, h, page): None for h in block_hashes(own) if h is not None}
                bare = all(r != CONTENT for r in roles)
                if any(r == OPEN and (bare or t.count(" ") >= RUN - 1) for r, t in own):
                    rows[host, None, None] = None
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "block", "page"])

    many = parsed.select("host", F.xxhash64("id").alias("page"), "roles", "blocks").mapInArrow(hashes, "host string, block bigint, page bigint")
    # A null page, which asks, is a group of its own and counts for none.
    pages = many.groupBy("host", "block", "page").agg(F.lit(1).alias("one"))
    return cut(pages.groupBy("host", "block").agg(F.count("page").alias("n"), F.max(F.col("page").isNull()).alias("asks")))


def _repeated_elsewhere(parsed: DataFrame) -> DataFrame:
    """(host, part, run): hashes of a group's runs that are on distinct pages of the host, whatever their groups.

    A host's runs are spread by hash; the first and last page of each are pre-aggregated, so that a run on every page
    gathers nowhere.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, parts, runs, pages = [], [], [], []
            for host, part, page, roles, blocks in zip(*(b.column(c).to_pylist() for c in ("host", "part", "page", "roles", "blocks")), strict=True):
                own = np.unique(run_hashes(stream_of([(page, list(zip(roles, blocks, strict=True)))])[0]))
                hosts += [host] * len(own)
                parts += [part] * len(own)
                pages += [page] * len(own)
                runs.append(own)
            flat = np.concatenate(runs) if runs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(parts, pa.int64()), pa.array(flat), pa.array(pages, pa.int64())], names=["host", "part", "run", "page"])

    many = parsed.select("host", "part", F.xxhash64("id").alias("page"), "roles", "blocks")
    runs = many.mapInArrow(hashes, "host string, part bigint, run bigint, page bigint")
    in_group = cut(runs.groupBy("host", "part", "run").agg(F.min("page").alias("low"), F.max("page").alias("high")))
    on_host = in_group.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    return in_group.select("host", "part", "run").join(on_host.select("host", "run"), ["host", "run"]).select("host", "part", "run")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    body = F.coalesce(F.col(html), F.lit(""))
    sizes = cut(pages.groupBy(host.alias("host")).agg(F.sum(F.octet_length(body)).alias("bytes")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    # Hosts whose pages make more than one group; the others need no entry to be dealt.
    groups = sizes.where(F.col("bytes") > group_bytes).select("host", F.ceil(F.col("bytes") / group_bytes).cast("int").alias("groups"))
    few = lambda hosts: F.broadcast(hosts) if hosts.count() <= MOST_HOSTS else hosts
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [blocks_of(h) for h in part.column(4).to_pylist()]
                roles = pa.array([[r for r, _ in b] for b in found], pa.list_(pa.int32()))
                blocks = pa.array([[t for _, t in b] for b in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], roles, blocks], names=["host", "part", "id", "url", "roles", "blocks"])

    sized = pages.select(host.alias("host"), F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).join(few(groups), "host", "left")
    part = F.pmod(F.xxhash64("id", "url"), F.coalesce("groups", F.lit(1))).cast("long")
    read = lambda df: df.select("host", part.alias("part"), "id", "url", "html").mapInArrow(parse, f"host string, part bigint, id {kind}, url string, roles array<int>, blocks array<string>")
    # Dealt by both, lest a join by host alone leave a hot host in one task; more bytes make more partitions.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    dealt = read(sized).repartition(parts, "host", "part").groupBy("host", "part")
    out = f"`{key}` {kind}, url string, text string, n_chars bigint"

    def finish(group: pd.DataFrame, found: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(group):  # hashes for a group that got no page
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (key, "url", "text", "n_chars")})
        hashes = lambda runs: found["hash"][found["of_run"] == runs].to_numpy(np.int64) if found is not None else np.zeros(0, np.int64)
        texts = texts_of(_rows(group), hashes(True), set(hashes(False).tolist()))
        return pd.DataFrame({key: group["id"], "url": group["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    on_host = _on_host(read(sized))
    hosts = on_host.where("block is null").select("host", F.greatest(F.lit(MOST_PAGES), F.ceil(F.col("n") / 2)).alias("most"), "asks")
    last = F.greatest(F.ceil(F.col("bytes") / group_bytes).cast("long"), F.lit(1).cast("long")) - 1
    parts_of = sizes.select("host", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    site = on_host.where("block is not null").join(hosts, "host").where("n >= most").select("host", "block").join(parts_of, "host")
    known = site.select("host", "part", F.col("block").alias("hash"), F.lit(False).alias("of_run"))
    asking = hosts.where("asks").select("host")
    if not asking.isEmpty():
        runs = _repeated_elsewhere(read(sized.join(few(asking), "host", "left_semi")))
        known = known.unionByName(runs.select("host", "part", F.col("run").alias("hash"), F.lit(True).alias("of_run")))
    elif site.isEmpty():
        return dealt.applyInPandas(lambda group: finish(group), out)
    return dealt.cogroup(known.groupBy("host", "part")).applyInPandas(lambda group, found: finish(group, found), out)
