"""Operator 6: main text of web pages, by markup and by a suffix array over each host.

Markup decides first: scripts, styles, menus, headers, footers, sidebars, adverts, forms, notices and comments are cut,
and a page that declares its article (article, main, role=main) has its text taken from there. Then every page is judged
by its host: the texts of the host's pages are concatenated as token streams whose suffixes are sorted by prefix doubling
to a depth of LONG tokens, and substrings that long which begin suffixes of enough distinct pages are boilerplate. Covered
tokens go and the unique runs stay. What is enough depends on what markup says:

* Where a page leaves its article undeclared, MIN_PAGES distinct pages, what markup cut from all pages as evidence.
* In a declared article, the articles of SHARE of the host's pages that declare one, both as rows and as distinct articles,
  and of ARTICLES distinct ones: a site's furniture is on nearly all of its pages, a passage that articles quote from each
  other or an advert repeats is not and stays. An article of which that covers more than half is a copy and stays whole.

Hosts of more than CHUNK pages are judged in pieces, each with a suffix array of its own, and with the same result. What
is on SHARE of all rows is on SHARE of the rows of one piece at least, so that the pieces' arrays name all candidates for
furniture; these are counted over the whole host. For undeclared pages the pieces' arrays give the number of distinct
pages of every run, added up over the host by hashes of the runs; a part only gets the result for the runs that it holds.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, bounded_broadcast, materialise, mix, release, slices, spread, table, word_hashes

LONG, MIN_PAGES, CHUNK = 8, 3, 2000
#: What furniture in declared articles is found on: distinct articles, and of a host's pages this fraction.
ARTICLES, SHARE = 10, (3, 4)
#: Bytes of text in one suffix array of a host in pieces.
PIECE = 8 << 20
#: Hosts or runs broadcast at most.
BROADCAST = 1_000_000
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|$)", re.S)  # last: a quote without its end
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp"}
_CUT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "svg", "object", "canvas", "audio", "video", "dialog", "menu", "map", "datalist", "fieldset"} | _RAW
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext"}
_CLOSES_P = {"p", "div", "section", "article", "main", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "hr", "header", "footer", "nav", "aside", "form", "dl", "address", "details", "dialog", "fieldset", "menu"}
_HEAD = {"title", "meta", "link", "style", "script", "base", "noscript", "template", "head"}
_DECLARED = {"article", "main"}
_SCOPE = {"table", "td", "th", "caption", "button", "object", "html"}
#: Elements that end where a next one begins, up to the container in which they stand: begun tag, ended tags, containers.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set())} | {t: ({"p"}, _SCOPE) for t in _CLOSES_P}
#: Class and id names of what is not the article. A name of several parts counts if all its parts are of the two kinds.
_NAMES = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|subscription|sidebar|sidenav|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|disqus|replies|reply|share|sharing|social|related|recommended|recommendations|widgets?|toolbar|pagination|pager|skip|copyright", re.I)
_PARTS = re.compile(r"site|page|main|global|top|bottom|left|right|side|upper|lower|primary|secondary|mobile|desktop|sticky|fixed|bar|box|block|list|items?|section|area|container|wrapper|wrap|outer|inner|panel|links?|posts?|articles|stories|contents?|news|module|region|slots?|units?|buttons?|icons?|form|signup|policy|message|overlay|dialog|thread|to|js|col|column|row|text|title|[0-9]*", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}


def _attrs(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(text)} if text else {}


def _named(names: str) -> bool:
    for name in names.split():
        parts = re.split("[_-]+", name)
        named = [bool(_NAMES.fullmatch(p)) for p in parts]
        if any(named) and all(n or _PARTS.fullmatch(p) for n, p in zip(named, parts, strict=True)):
            return True
        if "side" in parts and {"bar", "nav", "menu", "column", "col", "panel"} & set(parts):
            return True
    return False


def _cut(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _CUT:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return attrs.get("role", "").lower() in _ROLES or _named(attrs.get("class", "")) or _named(attrs.get("id", ""))


class Open:
    """The open elements, with the place of the outermost one that is cut and the number of those that declare the article."""

    def __init__(self):
        self.tags: list[str] = []
        self.declared: list[bool] = []
        self.cut: int | None = None
        self.depth = 0

    def push(self, tag: str, cut: bool, declared: bool) -> None:
        if cut and self.cut is None:
            self.cut = len(self.tags)
        declared = declared and self.cut is None
        self.tags.append(tag)
        self.declared.append(declared)
        self.depth += declared

    def pop(self, to: int) -> None:
        self.depth -= sum(self.declared[to:])
        del self.tags[to:], self.declared[to:]
        if self.cut is not None and self.cut >= to:
            self.cut = None

    def begins(self, tag: str) -> None:
        """Ends what ``tag`` ends by beginning."""
        if self.tags and self.tags[-1] == "head" and tag not in _HEAD:
            self.pop(len(self.tags) - 1)
        ended, within = _ENDS.get(tag, ((), ()))
        if not ended:
            return
        to = None
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i] in ended:
                to = i
                if tag not in ("tr", "tbody"):
                    break
            elif self.tags[i] in within:
                break
        if to is not None:
            self.pop(to)

    def ends(self, tag: str) -> None:
        """Ends the nearest ``tag`` and all within; not through a table cell or a declared article around it."""
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i] == tag:
                self.pop(i)
                return
            if tag not in ("html", "body") and (self.declared[i] or self.tags[i] in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", *_DECLARED)):
                return


def parse(page: str) -> tuple[list[str], bool, list[str]]:
    """(blocks of the declared article, or else of the page without what markup cuts; whether declared; cut blocks)."""
    article: list[str] = []
    rest: list[str] = []
    gone: list[str] = []
    declared, open_ = False, Open()
    at, end, low = 0, len(page), None
    while at <= end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            (gone if open_.cut is not None else article if open_.depth else rest).append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m.group(1) or m.group(4)), _attrs(m.group(3) or m.group(6))
        if not closing and tag in _RAW:
            low = page.lower() if low is None else low
            close = low.find(f"</{tag}", at)
            at = end if close < 0 else (page.find(">", close) + 1 or end)
            continue
        if tag not in _INLINE:
            for x in (article, rest, gone):
                x.append(" \n ")
        if closing:
            open_.ends(tag)
            continue
        open_.begins(tag)
        if tag in _VOID:
            continue
        mine = tag in _DECLARED or attrs.get("role", "").lower() in _DECLARED
        open_.push(tag, _cut(tag, attrs), mine)
        declared = declared or open_.declared[-1]
    return (article if declared else rest), declared, gone


def text_of(pieces: list[str]) -> str:
    """References decoded, blocks trimmed and joined, white space as one space."""
    return " ".join(entities.unescape("".join(pieces)).split())


class Suffixes:
    """The suffix array of some texts to a depth of ``long`` tokens: suffixes with equal first ``long`` tokens have equal ranks."""

    def __init__(self, texts: list[str], long: int):
        self.words, self.long = Words(pa.array(texts, pa.string()), lower=False), long
        self.starts = self.words.starts
        n = np.diff(self.starts)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        self.at = np.flatnonzero(self.starts[1:][self.owner] - np.arange(len(self.owner)) >= long)  # where suffixes that long begin
        rank, done = self.words.ids.astype(np.int64), 1  # by their first ``done`` tokens; read only where a text has that many left
        while done < long <= len(rank):
            step = min(done, long - done)
            rank[: len(rank) - step] = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
            rank = np.unique(rank, return_inverse=True)[1].reshape(-1)
            done += step
        _, first, rank = np.unique(rank[self.at], return_index=True, return_inverse=True)
        self.rank, self.first = rank.reshape(-1), self.at[first]  # a place for each rank
        pairs = np.unique(self.rank * max(len(texts), 1) + self.owner[self.at])  # the texts of each rank, once
        self.held, self.holder = np.divmod(pairs, max(len(texts), 1))

    def count(self, weights: np.ndarray) -> np.ndarray:
        """For each rank, the weights of its texts."""
        return np.bincount(self.held, weights[self.holder], len(self.first)).astype(np.int64)

    def covered(self, ranks: np.ndarray) -> list[np.ndarray]:
        """Which tokens of each text lie in a substring of one of the ``ranks`` (a mask)."""
        edge = np.zeros(len(self.owner) + 1, np.int32)
        at = self.at[ranks[self.rank]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.long, -1)
        return np.split(np.cumsum(edge[:-1]) > 0, self.starts[1:-1])

    def hashes(self, ranks: np.ndarray) -> np.ndarray:
        """The hashes of the runs of the ``ranks`` (a mask), as ``run_hashes`` gives them."""
        h = self.words.hashes()
        return _folded([h[self.first[ranks] + i] for i in range(self.long)])


def covered(streams: list[list[str]], long: int = LONG, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """Which tokens of each stream lie in substrings of ``long`` tokens or more that begin suffixes of at least
    ``min_pages`` distinct streams. Equal streams are one page."""
    distinct: dict[str, int] = {}
    page = [distinct.setdefault(" ".join(s), len(distinct)) for s in streams]
    array = Suffixes(list(distinct), long)
    out = array.covered(array.count(np.ones(len(distinct))) >= min_pages)
    return [out[p] for p in page]


def furniture(rows, distinct, all_rows, all_distinct, articles: int):
    """Whether so many of the rows and distinct articles of a host that has so many in all make a run its furniture."""
    part, of = SHARE
    return (of * rows >= part * all_rows) & (of * distinct >= part * all_distinct) & (distinct >= articles)


def without(text: str, gone: np.ndarray, declared: bool) -> str:
    """The text without the tokens that are ``gone``; a declared article of which most would go stays."""
    n = int(gone.sum())
    return text if not n or declared and 2 * n > len(gone) else " ".join(np.array(text.split(), object)[~gone])


_ROWS = "page_id bigint, url string, host string, key bigint, body string, evidence string, settled boolean"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], []]
        for h in b.column(2).to_pylist():
            blocks, declared, gone = parse(h or "")
            for c, v in zip(out, (text_of(blocks), text_of(gone), declared), strict=True):
                c.append(v)
        key = b.column(4)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), key, pa.array(out[0]), pa.array(out[1]), pa.array(out[2])], names=[x.split()[0] for x in _ROWS.split(", ")])


def _judge(long: int, min_pages: int, articles: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        settled = rows["settled"].to_numpy(bool)
        at: dict[tuple[bool, str], int] = {}
        page = [at.setdefault((d, t), len(at)) for d, t in zip(settled.tolist(), rows["body"], strict=True)]
        copies = np.bincount(page, minlength=len(at))
        if not settled.all():
            for t in rows["evidence"]:
                at.setdefault((False, t), len(at))
        article = np.array([d and t != "" for d, t in at], bool)
        copies = np.where(article, np.pad(copies, (0, len(at) - len(copies))), 0)
        array = Suffixes([t for _, t in at], long)
        common = array.count(np.array([not d for d, _ in at], float)) >= min_pages
        often = furniture(array.count(copies), array.count(article.astype(float)), copies.sum(), article.sum(), articles)
        loose, declared = array.covered(common), array.covered(often)
        texts = [without(t, (declared if d else loose)[p], d) for p, d, t in zip(page, settled.tolist(), rows["body"], strict=True)]
        return pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts})

    return run


def _folded(tokens: list[np.ndarray]) -> np.ndarray:
    """Hashes of runs from those of their first, second, ... tokens."""
    x = np.zeros(len(tokens[0]), np.uint64)
    with np.errstate(over="ignore"):
        for h in tokens:
            x = mix(x * np.uint64(0x100000001B3) ^ h)
    return x.view(np.int64)


def run_hashes(text: str, long: int) -> np.ndarray:
    """A hash for each place of the text where ``long`` tokens begin."""
    h = word_hashes(pa.array(text.split(), pa.string()))
    n = max(len(h) - long + 1, 0)
    return _folded([h[i : i + n] for i in range(long)])


def _arrays(long: int, chunk: int, of):
    """The suffix arrays of each host's texts in pieces, from (h, ..., text): h with what ``of`` gives for an array and the
    number of rows with each of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            order = np.argsort(h, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(h[order])) + 1) if len(h) else ():
                mine = b.column(b.num_columns - 1).take(pa.array(rows))
                n = max(-(-len(rows) // chunk), -(-mine.nbytes // PIECE))  # even pieces: small ones name more than they need
                for at in np.array_split(np.arange(len(rows)), min(n, len(rows))):
                    texts, copies = np.unique(np.array(mine.take(pa.array(at)).to_pylist(), object), return_counts=True)
                    got = of(Suffixes(texts.tolist(), long), copies)
                    first = next(iter(got.values()))
                    yield pa.RecordBatch.from_pydict({"h": pa.array(np.full(len(first), h[rows[0]])), **{k: pa.array(v) for k, v in got.items()}})
        release()

    return run


def _often(array: Suffixes, copies: np.ndarray) -> dict[str, np.ndarray]:
    """The runs on SHARE of the rows."""
    part, of = SHARE
    return {"run": array.hashes(of * array.count(copies) >= part * copies.sum())}


def _counted(array: Suffixes, copies: np.ndarray) -> dict[str, np.ndarray]:
    """Every run with the number of its rows."""
    n = array.count(copies)
    return {"run": array.hashes(n > 0), "n": n}


def _runs(long: int, keys: int):
    """The distinct runs of the text in the column after ``keys`` columns, each with those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                found = [np.unique(run_hashes(t or "", long)) for t in c.column(keys).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([*(c.column(k).take(at) for k in range(keys)), pa.array(np.concatenate(found))], names=[*c.schema.names[:keys], "run"])

    return run


def _held(text: str, runs: np.ndarray, long: int) -> np.ndarray:
    """Which tokens of the text lie in one of the runs."""
    edge = np.zeros(len(text.split()) + 1, np.int64)
    at = np.flatnonzero(np.isin(run_hashes(text, long), runs))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + long, -1)
    return np.cumsum(edge[:-1]) > 0


def _uncovered(long: int):
    def run(rows: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
        runs = np.unique(common["run"].to_numpy(np.int64))
        texts = [without(t, _held(t, runs, long), False) for t in rows["body"]]
        return pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts})

    return run


def _judge_large(part: DataFrame, long: int, min_pages: int, chunk: int) -> DataFrame:
    """What ``_judge`` gives for undeclared pages, for hosts in several parts."""
    undecided = part.where(~F.col("settled"))
    texts = undecided.select("host", F.col("body").alias("t")).unionAll(part.select("host", F.col("evidence").alias("t"))).where("t <> ''")
    distinct = texts.groupBy("host", F.xxhash64("t").alias("a"), F.hash("t").alias("b")).agg(F.min("t").alias("t"))  # equal streams are one page
    runs = distinct.select(F.xxhash64("host").alias("h"), "t").mapInArrow(_arrays(long, chunk, _counted), "h bigint, run bigint, n bigint")
    common = materialise(runs.groupBy("h", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages).select("h", "run"))
    held = undecided.select(F.xxhash64("host").alias("h"), "part", "body").mapInArrow(_runs(long, 2), "h bigint, part bigint, run bigint")
    found = held.join(bounded_broadcast(common, BROADCAST), ["h", "run"]).distinct().groupBy("h", "part")  # a run once a part, however many of its pages hold it
    rows = undecided.select(F.xxhash64("host").alias("h"), "part", "page_id", "url", "body").groupBy("h", "part")
    return rows.cogroup(found).applyInPandas(_uncovered(long), "page_id bigint, url string, text string")


def _unfurnished(long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = [without(t, _held(t, np.array(r, np.int64), long), True) for t, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def _articles_large(read: DataFrame, long: int, articles: int, chunk: int) -> DataFrame:
    """What ``_judge`` gives for declared articles, for hosts in pieces as they are read."""
    settled = read.where("settled").select("page_id", "url", F.col("body").alias("text"), F.xxhash64("host").alias("h"))
    whole = settled.select("page_id", "url", "text")
    texts = settled.where("text <> ''").select("h", F.xxhash64("text").alias("b"), "text")
    often = materialise(texts.mapInArrow(_arrays(long, chunk, _often), "h bigint, run bigint").distinct())
    if not often.limit(1).count():
        return whole
    every = texts.groupBy("h").agg(F.count("*").alias("all_rows"), F.countDistinct("b").alias("all_distinct"))
    runs = texts.mapInArrow(_runs(long, 2), "h bigint, b bigint, run bigint").join(bounded_broadcast(often, BROADCAST), ["h", "run"])
    runs = runs.groupBy("h", "run").agg(F.count("*").alias("rows"), F.countDistinct("b").alias("distinct")).join(every, "h")
    found = runs.where(furniture(F.col("rows"), F.col("distinct"), F.col("all_rows"), F.col("all_distinct"), articles))
    found = materialise(found.groupBy("h").agg(F.collect_list("run").alias("runs")))  # on SHARE of the pages: not many
    if not found.limit(1).count():
        return whole
    settled = settled.join(bounded_broadcast(found, BROADCAST), "h", "left")
    changed = settled.where("runs is not null").select("page_id", "url", "text", "runs").mapInArrow(_unfurnished(long), "page_id bigint, url string, text string")
    return settled.where("runs is null").select("page_id", "url", "text").union(changed)


def main_text(pages: DataFrame, *, long: int = LONG, min_pages: int = MIN_PAGES, chunk: int = CHUNK, articles: int = ARTICLES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Null html: empty text. Null urls share the host "". Repeated rows give repeated rows and count as one page. Broken
    markup is read as it comes: an element without an end reaches to the end of the page. Other columns are ignored. An
    empty table gives an empty table.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    rows = rows.select("page_id", "url", "html", "host", F.xxhash64("page_id", "url", "html").alias("key"))
    large = materialise(rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select(F.col("host").alias("h"), F.ceil(F.col("n") / chunk).cast("bigint").alias("chunks")))
    judge = _judge(long, min_pages, articles)
    if not large.limit(1).count():
        judged = rows.mapInArrow(_parsed, _ROWS).groupBy("host").applyInPandas(judge, "page_id bigint, url string, text string")
    else:
        big = bounded_broadcast(large, BROADCAST)
        small = rows.join(big, F.col("host") == F.col("h"), "left_anti").mapInArrow(_parsed, _ROWS)
        read = materialise(rows.join(big, F.col("host") == F.col("h"), "left_semi").mapInArrow(_parsed, _ROWS))
        judged = small.groupBy("host").applyInPandas(judge, "page_id bigint, url string, text string").union(_articles_large(read, long, articles, chunk))
        # only hosts with undecided pages are gathered
        undecided = materialise(read.where("not settled").select("host").distinct().join(large, F.col("host") == F.col("h")).select("h", "chunks"))
        if undecided.limit(1).count():
            read = read.withColumn("body", F.when(~F.col("settled"), F.col("body")).otherwise(""))
            part = read.join(bounded_broadcast(undecided, BROADCAST), F.col("host") == F.col("h")).select("page_id", "url", "host", "body", "evidence", "settled", F.pmod("key", "chunks").alias("part"))
            judged = judged.union(_judge_large(part, long, min_pages, chunk))
    return judged.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's extraction from every row of ``pages``."""
    return main_text(spread(table(spark, sf_dir, "pages")))
