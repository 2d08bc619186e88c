"""Main text of web pages: markup tells most of it, a host suffix array finds the boilerplate that markup doesn't tell.

A page's html becomes blocks of text. Blocks in an article (else in main) are its main text, less what lies in menus,
headers, footers, sidebars, notices, adverts, forms and reader comments. All other blocks of a host's pages are joined
to one token stream, whose suffixes are sorted by prefix doubling: runs of `run` tokens or more that several distinct
pages of the host hold are boilerplate. On a page without article or main, blocks are kept less the runs so covered.
An article loses what its host's markup calls boilerplate elsewhere: runs of `run` tokens that `half` of the host's
distinct pages hold outside their articles (or in dropped elements) and at least LEAKS different articles hold as well.
All other text that an article shares with other pages stays: copies, quotes and frequent lines are content, and what
one article alone has is where a teaser was taken from.

Copies of a page (equal blocks and article) are worked on once and count as one page. Hosts of at most `group` distinct pages are
worked on whole, several in a task; a larger host's pages are dealt into groups of about that many by the hash of their
blocks. Each group's suffix array gives how many of its pages hold each run, and these counts are added up over the host
(runs are told apart by 64-bit hashes there), so what is boilerplate doesn't depend on how a host is dealt. At most
1 / share times a page's mean number of runs can be boilerplate of a host, and only those are sent back to its groups.

Defined cases: null and empty html give the empty string; pages with a null or malformed url form one host; equal
rows give equal rows; cut-off pages end where they are cut; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.session import ship, written

#: So many hosts' counts may be broadcast.
FEW_HOSTS = 20_000
#: So many different articles have to hold what is cut from them.
LEAKS = 3
TEXTS = "host string, digest string, text string"
# HTML element names by their role, and the names that class, id and role attributes give to what is no main text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "noscript", "template", "svg", "canvas", "object", "video", "audio", "map", "fieldset"}
BOILER = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search"}

_token = re.compile(r"""<!--(?:>|->)?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""")
_attribute = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _boilerplate(attributes: str) -> bool:
    for name, value in _attribute.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and any(p in BOILER for p in re.split(r"[\s_-]+", value)):
            return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool, str]]:
    """(container: "article", "main" or "", dropped, text with white space made one space) of each block that has text.

    An article or main itself is a block without text, before those in it."""
    out: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool]] = []  # (tag, container, dropped) of the open elements
    parts: list[str] = []
    container, dropped, at, n = "", False, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((container, dropped, text))

    while at < n:
        m = _token.search(page, at)
        if m is None:
            tail = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", tail)  # a tag that the page's end cuts off
            parts.append(tail[: cut.start()] if cut else tail)
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--"):
            if not m[0].endswith(">"):
                end = page.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if any(t == name for t, _, _ in stack):
                if name not in INLINE:
                    flush()
                elif stack[-1][0] != name and any(t not in INLINE for t, _, _ in stack[[t for t, _, _ in stack].index(name) :]):
                    continue  # an inline element's end doesn't end the blocks within it
                while stack.pop()[0] != name:
                    pass
                container, dropped = stack[-1][1:] if stack else ("", False)
            elif name not in INLINE:
                flush()
            continue
        if name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            at = n if end is None else page.find(">", end.start()) + 1 or n
            continue
        if name not in INLINE:
            flush()
        if name in VOID or (m[3] or m[6] or "").endswith("/") and name not in INLINE and name not in DROPPED:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            stack.pop()
            container, dropped = stack[-1][1:] if stack else ("", False)
        inner = "article" if name == "article" or container == "article" else "main" if name == "main" or container == "main" else ""
        gone = dropped or name in DROPPED or name not in ("html", "body") and _boilerplate(m[3] or m[6] or "")
        if gone != dropped or inner != container:
            flush()
        if name in ("article", "main") and not gone:
            out.append((inner, False, ""))  # it is there, even if it has no text
        stack.append((name, inner, gone))
        container, dropped = inner, gone
    flush()
    return out


def suffix_ranks(stream: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix its rank by its first `depth` tokens (a power of two), by prefix doubling; equal ones share a rank."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(stream)
    while step < depth:
        following = np.full(n, -1, np.int64)
        following[: max(0, n - step)] = rank[step:]
        order = np.lexsort((following, rank))
        new = np.ones(n, np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (following[order][1:] != following[order][:-1])
        rank[order] = np.cumsum(new) - 1
        step *= 2
    return rank


class Runs(NamedTuple):
    """The runs of some pages' blocks, in the blocks' order: `run` tokens of one block, or a whole block that has fewer."""

    label: np.ndarray  # equal where tokens are equal
    key: np.ndarray  # the same for runs of any pages: a 64-bit hash
    page: np.ndarray  # number of the distinct page
    at: np.ndarray  # its first token, counted over all blocks
    length: np.ndarray
    n_pages: int  # distinct ones


def runs_of(pages: list[list[list[str]]], run: int, own: Iterable[str] | None = None) -> Runs:
    """All runs of the pages, labelled by the suffix array of their joined tokens. Pages with equal blocks are one, if what is their own is equal too."""
    copies: dict[tuple[str, tuple[tuple[str, ...], ...]], int] = {}
    number = [copies.setdefault((o, tuple(map(tuple, p))), len(copies)) for p, o in zip(pages, own if own is not None else [""] * len(pages), strict=True)]
    flat = [b for p in pages for b in p]
    owner = np.repeat(np.array(number, np.int64), [len(p) for p in pages])
    n = np.array([len(b) for b in flat], np.int64)
    first, long = np.cumsum(n) - n, n >= run
    # long blocks, each followed by a mark unlike any other: no run crosses blocks
    width = n[long] + 1
    block = np.repeat(np.flatnonzero(long), width)
    place = np.arange(len(block)) - np.repeat(np.cumsum(width) - width, width)
    token = place < n[block]
    codes, words = pd.factorize(np.array([t for b in flat if len(b) >= run for t in b], object))
    stream = -1 - np.arange(len(block))
    stream[token] = codes
    starts = np.flatnonzero(place + run <= n[block])
    hashes = np.zeros(len(block), np.uint64)
    hashes[token] = pd.util.hash_array(words.astype(object), categorize=False)[codes]
    key = np.zeros(len(starts), np.uint64)
    for k in range(run):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + k]
    label = suffix_ranks(stream, run)[starts] if len(starts) else np.zeros(0, np.int64)
    whole, texts = pd.factorize(np.array([" ".join(b) for b in flat if len(b) < run], object))
    short = np.flatnonzero(~long)
    return Runs(
        np.concatenate([label, len(stream) + whole]),
        np.concatenate([key, ~pd.util.hash_array(texts.astype(object), categorize=False)[whole]]),
        owner[np.concatenate([block[starts], short])],
        np.concatenate([first[block[starts]] + place[starts], first[short]]),
        np.concatenate([np.full(len(starts), run), n[short]]),
        len(copies),
    )


def holders(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(number of a run with each label that occurs, how many distinct pages hold it)."""
    pairs = np.unique(np.stack([runs.label, runs.page], axis=1), axis=0)
    _, count = np.unique(pairs[:, 0], return_counts=True)
    _, some = np.unique(runs.label, return_index=True)
    return some, count


def covered(pages: list[list[list[str]]], runs: Runs, hit: np.ndarray) -> list[list[np.ndarray]]:
    """For each token of each page's blocks, whether it lies in one of the runs that hit tells."""
    n = [[len(b) for b in p] for p in pages]
    change = np.zeros(sum(map(sum, n)) + 1, np.int64)
    np.add.at(change, runs.at[hit], 1)
    np.add.at(change, (runs.at + runs.length)[hit], -1)
    inside, at = np.cumsum(change) > 0, 0
    out: list[list[np.ndarray]] = []
    for p in n:
        out.append([])
        for k in p:
            out[-1].append(inside[at : at + k])
            at += k
    return out


def repeated(pages: list[list[list[str]]], run: int, share: float, own: Iterable[str] | None = None) -> list[list[np.ndarray]]:
    """For each token of each page's blocks, whether it lies in a run that max(3, share of the pages) distinct pages hold.

    Pages with equal blocks are copies and count as one: what only they share is content. A run is `run` tokens of one block, or a whole block that has fewer."""
    runs = runs_of(pages, run, own)
    some, count = holders(runs)
    often = runs.label[some][count >= max(3, int(share * runs.n_pages))]
    return covered(pages, runs, np.isin(runs.label, often))


def parted(page: list[tuple[str, bool, str]]) -> tuple[str | None, list[tuple[bool, str]]]:
    """(main text, or None if no container tells it; the other blocks as (dropped, text)) of a page's blocks."""
    for kind in ("article", "main"):
        if any(c == kind and not d for c, d, _ in page):
            return " ".join(t for c, d, t in page if c == kind and not d and t), [(d, t) for c, d, t in page if c != kind and t]
    return None, [(d, t) for _, d, t in page if t]


def tokens(around: Iterable[Iterable[str]]) -> list[list[list[str]]]:
    return [[text.split(" ") for text in p] for p in around]


def kept_text(dropped: Iterable[bool], blocks: list[list[str]], gone: list[np.ndarray]) -> str:
    """What a page's blocks leave: those not dropped, less the tokens that are gone."""
    return " ".join(t for d, block, g in zip(dropped, blocks, gone, strict=True) if not d for t, c in zip(block, g, strict=True) if not c)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", *, group: int = 256, run: int = 8, share: float = 0.1, half: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars for each page.

    Pages are parsed once, into a written table. What they have outside their articles, a small part, is dealt out by
    host, for all hosts; articles are read again only on hosts where it shows boilerplate that articles may hold."""
    spark = pages.sparkSession
    ship(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.col(page).cast("string").alias("html"))
    schema = T.StructType([rows.schema["page_id"], *T.StructType.fromDDL("url string, host string, text string, dropped array<boolean>, around array<string>").fields])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 500):
                some = b.iloc[s : s + 500]
                got = [parted(blocks(h or "")) for h in some["html"]]
                yield some[["page_id", "url", "host"]].assign(text=pd.Series([t for t, _ in got], index=some.index, dtype=object), dropped=pd.Series([[d for d, _ in a] for _, a in got], index=some.index, dtype=object), around=pd.Series([[t for _, t in a] for _, a in got], index=some.index, dtype=object))

    parsed = written(rows.mapInPandas(parse, schema), "pages")
    told = parsed.where("text is not null").select("page_id", "url", "host", "text")
    # no text has a newline, so that only equal blocks have equal digests
    digest = F.sha2(F.concat_ws("\n", F.col("dropped").cast("array<string>"), "around"), 256)
    article = F.coalesce(F.sha2("text", 256), F.lit(""))
    contents = parsed.groupBy("host", digest.alias("digest"), article.alias("own")).agg(F.first("dropped").alias("dropped"), F.first("around").alias("around"))
    contents = written(contents, "contents")
    sizes = written(contents.groupBy("host").agg(F.count("*").alias("n"), F.bool_or(F.col("own") == "").alias("open")), "sizes")
    n_hosts, total, n_open = sizes.agg(F.count("*"), F.sum("n"), F.count_if("open")).first()
    done = _cleared(told, contents.join(F.broadcast(sizes) if n_hosts <= FEW_HOSTS else sizes, "host"), max(1, (total or 0) // group), group, run, half).withColumn("n_chars", F.length("text").cast("long"))
    if not n_open:
        return done
    sizes = sizes.where("open")
    contents = contents.withColumn("wanted", F.col("own") == "")
    dealt = contents.join(F.broadcast(sizes) if n_open <= FEW_HOSTS else sizes, "host")

    def of_small(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pd.Series(None, index=pdf.index, dtype=object)
        for _, h in pdf.groupby("host", sort=False):
            p = tokens(h["around"])
            texts[h.index] = [kept_text(*x) for x in zip(h["dropped"], p, repeated(p, run, share, h["own"]), strict=True)]
        return pdf[["host", "digest"]].assign(text=texts)[pdf["wanted"]]

    small = dealt.where(F.col("n") <= group).groupBy(F.pmod(F.xxhash64("host"), F.lit(max(1, total // group))).alias("bucket")).applyInPandas(of_small, TEXTS)
    rest = small
    if not sizes.where(F.col("n") > group).isEmpty():
        rest = small.union(_of_large(dealt.where(F.col("n") > group), group, run, share))
    rest = parsed.where("text is null").withColumn("digest", digest).select("page_id", "url", "host", "digest").join(rest, ["host", "digest"]).select("page_id", "url", "text")
    return done.union(rest.withColumn("n_chars", F.length("text").cast("long")))


def _cleared(told: DataFrame, dealt: DataFrame, cells: int, group: int, run: int, half: float) -> DataFrame:
    """page_id, url and text of told, less the runs that the host's markup calls boilerplate.

    dealt: the distinct pages' blocks outside articles, with their host's number of pages. Cells hold a large host's group or several small hosts."""
    salt = F.when(F.col("n") > group, F.pmod(F.xxhash64("around", "own"), F.ceil(F.col("n") / group))).otherwise(-1)
    cell = F.when(salt < 0, F.pmod(F.xxhash64("host"), F.lit(cells))).otherwise(F.xxhash64("host", salt))

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for host, h in pdf.groupby("host", sort=False):
            # on a page with an article, all that lies outside is marked as no main text; on others, what is dropped
            blocks = [[b for d, b in zip(ds, bs, strict=True) if d or o] for ds, bs, o in zip(h["dropped"], h["around"], h["own"], strict=True)]
            runs = runs_of(tokens(blocks), run, h["own"] + h["digest"])
            some, count = holders(runs)
            some, count = some[runs.length[some] == run], count[runs.length[some] == run]
            out.append(pd.DataFrame({"host": host, "run": np.append(runs.key[some].view(np.int64), 0), "pages": np.append(count, runs.n_pages), "all": np.append(np.zeros(len(some), bool), True)}))
        return pd.concat(out)

    counts = written(dealt.groupBy(cell.alias("cell")).applyInPandas(marked, "host string, run long, pages long, all boolean"), "marked")
    needed = counts.where("all").groupBy("host").agg(F.greatest(F.lit(3), F.ceil(F.lit(half) * F.sum("pages"))).alias("needed"))
    sure = counts.where("not all").groupBy("host", "run").agg(F.sum("pages").alias("pages")).join(needed, "host").where("pages >= needed")
    # at most 1 / half times the runs that a page has outside its article
    sure = written(sure.groupBy("host").agg(F.collect_list("run").alias("runs")), "sure")
    plain = told.select("page_id", "url", "text")
    if sure.isEmpty():
        return plain

    def runs_in(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[list[list[str]]], Runs, np.ndarray]]:
        """Articles of one host at a time, with their runs and which of them are among the host's."""
        for _, h in b.groupby("host", sort=False):
            p = tokens([[t] for t in h["text"]])
            runs = runs_of(p, run)
            yield h, p, runs, np.isin(runs.key.view(np.int64), h["runs"].iloc[0])

    def leaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, p, runs, hit in runs_in(b):
                if hit.any():
                    first = np.cumsum([0, *(len(x[0]) for x in p)])
                    of = np.searchsorted(first, runs.at[hit], side="right") - 1
                    yield pd.DataFrame({"host": h["host"].iloc[0], "run": runs.key[hit].view(np.int64), "own": h["own"].to_numpy()[of]}).drop_duplicates()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, p, runs, hit in runs_in(b):
                gone = covered(p, runs, hit)
                yield h[["page_id", "url"]].assign(text=[kept_text([False], x, g) for x, g in zip(p, gone, strict=True)])

    some = told.withColumn("own", F.sha2("text", 256)).join(sure, "host").mapInPandas(leaks, "host string, run long, own string")
    leaked = some.distinct().groupBy("host", "run").agg(F.count("*").alias("n")).where(F.col("n") >= LEAKS)
    leaked = written(leaked.groupBy("host").agg(F.collect_list("run").alias("runs")), "leaked")
    if leaked.isEmpty():
        return plain
    rest = told.join(leaked, "host", "left")
    schema = T.StructType([told.schema["page_id"], *T.StructType.fromDDL("url string, text string").fields])
    return rest.where("runs is null").select("page_id", "url", "text").union(rest.where("runs is not null").mapInPandas(cut, schema))


def _of_large(dealt: DataFrame, group: int, run: int, share: float) -> DataFrame:
    """host, digest and text of the wanted pages of hosts that are dealt into groups."""
    groups = F.ceil(F.col("n") / group).cast("int")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("around", "own"), groups).cast("int"))

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = runs_of(tokens(pdf["around"]), run, pdf["own"])
        some, count = holders(runs)
        return pd.DataFrame({"host": pdf["host"].iloc[0], "run": np.append(runs.key[some].view(np.int64), 0), "pages": np.append(count, runs.n_pages), "all": np.append(np.zeros(len(some), bool), True)})

    counts = written(dealt.groupBy("host", "salt").applyInPandas(counted, "host string, run long, pages long, all boolean"), "runs")
    needed = counts.where("all").groupBy("host").agg(F.greatest(F.lit(3), F.floor(F.lit(share) * F.sum("pages"))).alias("needed"))
    often = counts.where("not all").groupBy("host", "run").agg(F.sum("pages").alias("pages")).join(needed, "host").where("pages >= needed")
    salts = dealt.select("host", groups.alias("groups")).distinct()
    often = often.join(salts, "host").select("host", "run", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))

    def cut(pdf: pd.DataFrame, often: pd.DataFrame) -> pd.DataFrame:
        p = tokens(pdf["around"])
        runs = runs_of(p, run, pdf["own"])
        gone = covered(p, runs, np.isin(runs.key.view(np.int64), often["run"].to_numpy(np.int64)))
        return pdf[["host", "digest"]].assign(text=[kept_text(*x) for x in zip(pdf["dropped"], p, gone, strict=True)])[pdf["wanted"]]

    return dealt.groupBy("host", "salt").cogroup(often.groupBy("host", "salt")).applyInPandas(cut, TEXTS)
