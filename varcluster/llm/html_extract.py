"""HTML extraction with host suffix arrays.

A page is cut into blocks at block-level tags, and each block is inside an article (article, main, role=main), inside a
marked container (menus, headers, footers, sidebars, notices, adverts, forms, comments, by tag, role, class or id), or
neither. Names mark as whole words or in known compounds; ids of headings, paragraphs and sections are names of places, of
which only comments and adverts mark. Articles are never marked, nor are elements that enclose one,
save asides, menus and comments (or what stands inside an article), of which only those that enclose a main are not.
A container ends where an element around it ends; one that is marked by its name and has no end tag of its own loses its
first block alone. Tags are found in one pass in linear time: quotes in tags count unless they are never closed.
Where a page has an article, its text is the article without marked containers: passages that pages share,
and whole copies of articles, are text there and stay. Where a page has none, its unmarked blocks are judged by what
the host repeats.

For that, the token streams of a host's pages (what lies outside articles) are concatenated, and a suffix array by
prefix doubling brings equal runs of RUN words together. A map task does so for its own pages and sends each distinct
run once, with the least and the greatest page it stands on; runs of one host are merged by a 64-bit hash, so a run
that any two pages of the host share is found, and a host with a third of all pages is never in one task. Repeated
runs cover words; covered words go, unique runs of words stay. A page of which nothing would stay is a copy of
another one and keeps its unmarked blocks.

Character references are decoded, white space inside a block (Unicode's) becomes one space, blocks are trimmed and
joined by newlines in page order; <br> is white space.

Nulls and edge cases: null html is empty and gives the empty text; null urls share one host, the empty one; null page
ids pass through and stand for pages of their own; repeated rows are extracted one by one and count as one page; text
without any tag is one block; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, mix, released, table

RUN = 8
#: Element names and the words of roles, classes and ids that mark a container.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
MARKED_TAGS = frozenset("aside button dialog footer form head header iframe menu nav noscript object select svg template textarea title".split())
MARKED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: A class, id or role marks if it is one of these words, ends in a hyphen and one of MARKED_ENDS (cookie-notice), or is one
#: of them, a hyphen and one of HOLDERS (ad-slot); not if it begins with one of STATES (has-sidebar).
MARKED_ENDS = frozenset("ad ads advert adverts banner breadcrumb breadcrumbs comments disqus footer masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo sidebar toolbar widget".split())
HOLDERS = frozenset("area bar block box button buttons container form holder inner item items left link links list overlay panel primary respond right secondary section slot unit wrap wrapper zone".split())
STATES = frozenset("has hide is no non not show single with without".split())
#: Of containers that enclose an article, those stay marked that hold others than the page's.
ASIDE_TAGS = frozenset("aside dialog footer iframe menu nav noscript object svg template".split())
REPLY_WORDS = frozenset("comment comments disqus replies reply".split())
ARTICLE_TAGS = frozenset(("article", "main"))
RAW_TAGS = ("script", "style")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where the next block starts, closed or not.
OPEN_TAGS = frozenset("p li dt dd option td th tr".split())

#: Elements whose id is an anchor, and the words that mark them all the same.
ANCHOR_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p section li dt dd td th".split())
ANCHOR_WORDS = frozenset("ad ads advert adverts advertisement advertising comments disqus replies sponsored".split())

_NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9]*)")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW_TAGS}
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_MAIN = re.compile(r"(?<![\w-])role\s*=\s*[\"']?\s*main\b(?!-)", re.I)
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Token(NamedTuple):
    """A tag, or a stretch without text (a comment, a script), whose name is None."""

    start: int
    end: int
    name: str | None = None
    close: bool = False
    attributes: str = ""


def tokens_of(page: str) -> list[Token]:
    """The tags of a page in order, in one pass. Where a tag's quotes leave it without an end, quotes no longer count from
    there on, so no stretch is looked at more than twice."""
    out: list[Token] = []
    quotes, at = True, page.find("<")
    while at >= 0:
        end = -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            out.append(Token(at, end))
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            if not end:
                break
            out.append(Token(at, end))
        elif found := _NAME.match(page, at + 1):
            close = -1
            if quotes:
                close = _tag_end(page, found.end())
                quotes = close >= 0
            if close < 0:
                close = page.find(">", found.end())
                if close < 0:
                    break
            name, end = found[2].lower(), close + 1
            if name in _RAW_END and not found[1]:
                raw = _RAW_END[name].search(page, end)
                end = raw.end() if raw else len(page)
                out.append(Token(at, end))
            else:
                out.append(Token(at, end, name, bool(found[1]), page[found.end() : close]))
        at = page.find("<", end if end >= 0 else at + 1)
    return out


def _tag_end(page: str, at: int) -> int:
    """The place of the first > outside quotes, or -1."""
    while found := _STOP.search(page, at):
        if found[0] == ">":
            return found.start()
        closing = page.find(found[0], found.end())
        at = found.end() if closing < 0 else closing + 1
    return -1


def _marks(name: str, attributes: str) -> set[str]:
    """The marked words that the class, id and roles of an element are made of."""
    found = set()
    for m in _MARK.finditer(attributes):
        anchor = name in ANCHOR_TAGS and m[1].lower() == "id"
        for token in m[2].lower().strip("\"'").split():
            parts = [w for w in re.split(r"[^a-z]+", token) if w]
            if not parts or len(parts) > 1 and parts[0] in STATES:
                continue
            if anchor:
                found.update(parts if len(parts) == 1 and parts[0] in ANCHOR_WORDS else ())
            elif len(parts) == 1 and parts[0] in MARKED_WORDS or len(parts) > 1 and parts[-1] in MARKED_ENDS:
                found.add(parts[-1])
            elif len(parts) > 1 and parts[0] in MARKED_WORDS and all(w in HOLDERS for w in parts[1:]):
                found.add(parts[0])
    return found


def _opens_article(name: str, attributes: str) -> bool:
    return name in ARTICLE_TAGS or bool(attributes) and _MAIN.search(attributes) is not None


def _enclosing(tokens: list[Token]) -> tuple[set[int], set[int], dict[int, int]]:
    """The numbers of the tokens that open an element with an article or main inside, and of those with a main; and for each
    that opens an element without an end tag of its own, the token that ends it, as the end of one around it does."""
    stack: list[tuple[str, int]] = []
    often: dict[str, int] = {}
    any_, main, left = set(), set(), {}
    for k, m in enumerate(tokens):
        if m.name is None:
            continue
        name = m.name
        if m.close:
            while often.get(name):
                last, opened = stack.pop()
                often[last] -= 1
                if last == name:
                    break
                left[opened] = k
            continue
        if name in VOID_TAGS or m.attributes.endswith("/") and name not in BLOCK_TAGS:
            continue
        while stack and stack[-1][0] in OPEN_TAGS and (stack[-1][0] == name or stack[-1][0] == "p" and name in BLOCK_TAGS):
            last, opened = stack.pop()
            often[last] -= 1
            left[opened] = k
        if _opens_article(name, m.attributes):
            for seen in (any_,) if name == "article" else (any_, main):
                for _, at in reversed(stack):
                    if at in seen:
                        break  # and all that enclose it
                    seen.add(at)
        stack.append((name, k))
        often[name] = often.get(name, 0) + 1
    left.update((opened, len(tokens)) for _, opened in stack)
    return any_, main, left


def blocks_of(page: str | None) -> tuple[list[str], list[tuple[str, bool]]]:
    """The blocks inside articles, and the other ones in order, each with whether it is unmarked."""
    page = page or ""
    inside: list[str] = []
    outside: list[tuple[str, bool]] = []
    parts: list[str] = []
    articles: list[list] = []  # the open ones: tag, and how many of that tag are open since
    skip, skip_tag, at, seen = 0, "", 0, False
    until, first = -1, False  # the token that ends a container without an end tag; whether its first block does
    tokens = tokens_of(page)
    around, around_main, left = _enclosing(tokens)

    def close() -> bool:
        """Whether there was a text."""
        text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip() if parts else ""
        if text:
            if articles and not skip:
                inside.append(text)
            else:
                outside.append((text, not skip))
        parts.clear()
        return bool(text)

    for k, m in enumerate(tokens):
        if m.start > at:
            parts.append(page[at : m.start])
        at = m.end
        name = m.name
        if name is None:
            continue
        if name == "br":
            parts.append(" ")
            continue
        block, marked = name in BLOCK_TAGS, name in MARKED_TAGS
        if skip and (k == until or first and block):
            if close() or k == until:
                skip, until, first = 0, -1, False
        if m.close:
            if block or name == skip_tag:
                close()
            if skip and until < 0 and name == skip_tag:
                skip -= 1
            elif not skip:
                for i in range(len(articles) - 1, -1, -1):
                    if articles[i][0] == name:
                        articles[i][1] -= 1
                        if not articles[i][1]:
                            close()
                            del articles[i:]
                        break
            continue
        attributes = m.attributes
        if block or marked:
            close()
        if name in VOID_TAGS or attributes.endswith("/") and name not in BLOCK_TAGS:
            continue
        if skip:
            skip += until < 0 and name == skip_tag
            continue
        opens = _opens_article(name, attributes)
        words = _marks(name, attributes) if attributes and not opens and name not in ("html", "body") else ()
        if opens and name == "article" and seen and not REPLY_WORDS.isdisjoint(_marks(name, attributes)):
            words = REPLY_WORDS  # a reader's comment, beside an article or in it
        if k in around_main or k in around and not articles and name not in ASIDE_TAGS and REPLY_WORDS.isdisjoint(words):
            marked, words = False, ()  # a wrapper of the page or of its article
        if marked and not opens or words:
            close()
            skip, skip_tag = 1, name
            until = left.get(k, -1)
            first = until >= 0 and not marked and name not in OPEN_TAGS
        elif opens:
            close()
            seen = True
            articles.append([name, 1])
        else:
            for a in reversed(articles):
                if a[0] == name:
                    a[1] += 1
                    break
    if at < len(page):
        parts.append(page[at:])
    close()
    return inside, outside


def _parse(url_col: str, html_col: str, names: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, streams, hosts = [], [], []
            for url, page in zip(batch[url_col], batch[html_col]):
                inside, outside = blocks_of(page)
                texts.append("\n".join(inside) if inside else None if any(keep for _, keep in outside) else "")
                streams.append([{"text": t, "unmarked": keep and not inside} for t, keep in outside])
                hosts.append(host_of(url))
            yield batch.drop(columns=[html_col]).assign(**{names["text"]: texts, names["outside"]: streams, names["host"]: hosts})

    return released(run)


def equal_runs(words: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of a stream, of suffixes with `run` words left on their page, by their first `run` words:
    the suffixes' places in order, the number of the run that each starts with, and a hash of it. words: 64-bit hashes."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    h, done = mix(words), 1
    while done < run:
        step = min(done, run - done)
        n = len(rank) - step
        rank = np.unique(rank[:n] * (np.int64(rank.max()) + 1) + rank[step:], return_inverse=True)[1].astype(np.int64)
        h = mix(h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        done += step
    whole = np.flatnonzero(page[: len(rank)] == page[run - 1 :])
    order = whole[np.argsort(rank[whole], kind="stable")]
    return order, rank[order], h[order]


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _runs(run: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [pd.DataFrame({c: pd.Series(dtype=object if c in ("host", "places") else np.int64) for c in ("host", "hash", "low", "high", "places")})]
            for host, pages in batch.groupby("host", sort=False):
                words, owner, place, judged = [], [], [], []
                for i, stream in enumerate(pages["outside"]):
                    own = [w for b in stream for w in b["text"].split(" ")]
                    words += own
                    owner += [i] * len(own)
                    place += range(len(own))
                    judged.append(any(b["unmarked"] for b in stream))
                if len(words) < run:
                    continue
                owner, place = np.array(owner), np.array(place)
                order, rank, h = equal_runs(word_hashes(words), owner, run)
                if not len(order):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
                ids, rows = pages["page"].to_numpy(np.int64), pages["row"].to_numpy(np.int64)
                of = ids[owner[order]]
                wanted = np.array(judged)[owner[order]]
                places = [[]] * len(heads)
                for k in np.flatnonzero(np.logical_or.reduceat(wanted, heads)).tolist():
                    part = order[heads[k] : heads[k + 1] if k + 1 < len(heads) else None]
                    places[k] = [{"row": int(rows[owner[p]]), "at": int(place[p])} for p in part if judged[owner[p]]]
                out.append(pd.DataFrame({"host": host, "hash": h[heads].view(np.int64), "low": np.minimum.reduceat(of, heads), "high": np.maximum.reduceat(of, heads), "places": places}))
            yield pd.concat(out[1:] or out)

    return released(send)


def unique_text(stream: list[dict], covered: np.ndarray, run: int) -> str:
    """The unmarked blocks without the words of covered runs, or with them if nothing else is left. A covered stretch
    that reaches into a block by less than a run, and does not fill it, is chance and stays."""
    sizes = [b["text"].count(" ") + 1 for b in stream]
    edge = np.zeros(sum(sizes) + 1, np.int64)
    np.add.at(edge, covered, 1)
    np.add.at(edge, covered + run, -1)
    stay, at, out = np.cumsum(edge)[:-1] == 0, 0, []
    for block, n in zip(stream, sizes):
        if block["unmarked"]:
            own = stay[at : at + n]
            edges = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a < min(run, n):
                    own[a:b] = True
            left = " ".join([w for w, k in zip(block["text"].split(" "), own.tolist()) if k])
            if left:
                out.append(left)
        at += n
    return "\n".join(out or [b["text"] for b in stream if b["unmarked"]])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """pages without html, with main_text and n_chars."""
    kept = [f for f in pages.schema.fields if f.name != html_col]
    names = {c: free_name(pages, c) for c in ("text", "outside", "host", "row", "places", "main_text", "n_chars")}
    stream = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("unmarked", T.BooleanType())]))
    schema = T.StructType([*kept, T.StructField(names["text"], T.StringType()), T.StructField(names["outside"], stream), T.StructField(names["host"], T.StringType())])
    parsed = materialise(pages.mapInPandas(_parse(url_col, html_col, names), schema).withColumn(names["row"], F.monotonically_increasing_id()), "parsed-pages")
    row, text = names["row"], F.col(names["text"])
    streams = parsed.where(F.size(names["outside"]) > 0).select(F.col(row).alias("row"), F.coalesce(F.col(id_col).cast("long"), -1 - F.col(row)).alias("page"), F.col(names["host"]).alias("host"), F.col(names["outside"]).alias("outside"))
    runs = materialise(streams.mapInPandas(_runs(run), "host string, hash long, low long, high long, places array<struct<row:long,at:int>>"), "host-runs")
    repeated = runs.groupBy("host", "hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("host", "hash")
    covered = runs.where(F.size("places") > 0).join(repeated, ["host", "hash"]).select(F.explode("places").alias("p")).groupBy(F.col("p.row").alias(row)).agg(F.collect_list("p.at").alias(names["places"]))

    @F.pandas_udf("string")
    def unique(outside: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([unique_text(list(s), np.array([] if p is None else p, np.int64), run) for s, p in zip(outside, places)])

    columns = [f.name for f in kept]
    articles = parsed.where(text.isNotNull()).select(*columns, text.alias(names["main_text"]))
    others = parsed.where(text.isNull()).join(covered, row, "left").select(*columns, unique(names["outside"], names["places"]).alias(names["main_text"]))
    return articles.union(others).withColumn(names["n_chars"], F.length(names["main_text"]).cast("long"))


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), "n_chars")
