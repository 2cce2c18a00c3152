"""Main text of web pages: blocks of text by their markup, and page differencing between near URLs.

A page becomes lines, one for each block, without the elements that are never its text. Pages are put in
order of host and path; each is held against the nearest page before or after it, of its host, whose path and
html are others: the one whose path shares the longest beginning. The lines of both are aligned by a longest
common subsequence. Lines that stand in both are the site's and are deleted, with one exception: a line within an
<article> or <main> may be a sentence that two articles share. It is the site's only if nearly all pages of the host have it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices
from quarry.llm.url_filter import parts
from quarry.plans.materialize import as_leaf, drop_leaf

SLICE = 2 << 20
#: A line within an article that the nearest page has too is the site's if so many paths of the host have it, and this share of them.
SITE_PATHS, SITE_SHARE = 8, 0.75
#: Elements whose text is none of the page's; the second kind only outside of articles.
NEVER = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg canvas object menu dialog datalist".split())
OUTSIDE = frozenset(["header"])
#: Last words of an element's classes and id that say the same, where none of BESIDE is before them.
MARKED = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu sidebar breadcrumb breadcrumbs cookie cookies consent notice popup modal newsletter subscribe share sharing social related comment comments disqus respond reply login signup pagination widget footer".split())
BESIDE = frozenset("has no with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul header".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
MAIN = frozenset(["article", "main"])

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|[^<]++", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def _unwanted(attributes: str) -> str:
    """How the element is marked as none of the page's text: `hidden`, or by its `name` or role; empty if it isn't."""
    found = ""
    for name, *values in _NAMED.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name in ("class", "id") and any(map(_marked, value.split())) or name == "role" and value in ROLES:
            found = "name"
    return found


def _marked(name: str) -> bool:
    words = _WORD.findall(name)
    return bool(words) and words[-1] in MARKED and BESIDE.isdisjoint(words[:-1])


class Tokens:
    """A page's tags and runs of text, one after the other, in time linear in its length.

    Quotes in tags are heeded until the first tag that has an open one; from there on a tag ends at the next >.
    """

    def __init__(self, page: str):
        self.page, self.at, self.tag = page, 0, _TAG
        self.last = page.rfind(">")
        self._closed: dict[str, int] = {}

    def next(self) -> re.Match | str | None:
        """A tag's match, with groups for /, name and attributes; a run of text; or None at the end."""
        page = self.page
        while self.at < len(page):
            if page[self.at] == "<":
                if self.at > self.last and not page.startswith("<!--", self.at):
                    text = page[self.at :]  # no tag ends any more
                    self.at = len(page)
                    return text
                m = self.tag.match(page, self.at)
                if m is None and page[self.at + 1 : self.at + 3].strip("/")[:1].isalpha():
                    m = _BARE.match(page, self.at)
                    if m is not None:
                        self.tag = _BARE
                if m is not None:
                    self.at = m.end()
                    return m
            m = _OTHER.match(page, self.at)
            if m is None:
                self.at += 1
                return "<"
            self.at = m.end()
            if m[0][0] != "<":
                return m[0]
        return None

    def pass_raw(self, tag: str) -> None:
        """Moves behind the end of an element of RAW, whose content isn't markup; without an end, behind everything."""
        found = _END[tag].search(self.page, self.at)
        self.at = found.end() if found else len(self.page)

    def closed(self, tag: str) -> bool:
        """Whether an end tag of this name is still to come."""
        if tag not in self._closed:
            self._closed[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\s*>", self.page, re.I)), default=-1)
        return self._closed[tag] >= self.at


def _around_main(page: str) -> set[int]:
    """Where the elements begin that have an <article> or <main> in them."""
    out: set[int] = set()
    opened: dict[str, list[int]] = {}
    tokens = Tokens(page)
    while (m := tokens.next()) is not None:
        if isinstance(m, str):
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                opened[tag].pop()
        elif tag in _END:
            tokens.pass_raw(tag)
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in MAIN:
                for starts in opened.values():
                    for x in reversed(starts):
                        if x in out:
                            break
                        out.add(x)
            opened.setdefault(tag, []).append(m.start())
    return out


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, whether it lies in an article) of each block with text, in page order."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    inside = 0
    around: set[int] | None = None
    skip, depth = "", 0  # the element that is left out, and how deep in elements of its name

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, inside > 0))

    tokens = Tokens(page)
    while (m := tokens.next()) is not None:
        if isinstance(m, str):
            if not skip:
                held.append(m)
            continue
        tag, ends = m[2].lower(), m[1] == "/"
        if skip:
            if tag == skip:
                depth += -1 if ends else 1
                if not depth:
                    skip = ""
            continue
        if not ends and tag not in VOID and not m[3].endswith("/"):
            drop = "never" if tag in NEVER or tag in OUTSIDE and not inside else _unwanted(m[3]) if tag not in ("html", "body") and tag not in MAIN and m[3] else ""
            if drop == "name":
                if around is None:
                    around = _around_main(page)
                if m.start() in around:
                    drop = ""
            if drop:
                if tag in _END:
                    tokens.pass_raw(tag)
                elif tokens.closed(tag):
                    skip, depth = tag, 1
                if tag in BLOCKS or tag in NEVER:
                    close()
                continue
        if tag in BLOCKS:
            close()
            if tag in MAIN:
                inside = max(0, inside + (-1 if ends else 1))
        elif tag == "br":
            held.append(" ")
    close()
    return out


#: Cells of an alignment's table that are held at once.
CELLS = 1 << 22


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of x and of each beginning of y."""
    best = np.zeros(len(y) + 1, np.int32)
    for v in x.tolist():
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], (best[:-1] + 1) * (y == v)))
    return best


def _aligned(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x of a longest common subsequence. Larger tables are halved, so that memory stays linear."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        return [0] if (y == x[0]).any() else []
    if len(x) * len(y) > CELLS:
        half = len(x) // 2
        cut = int((_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _aligned(x[:half], y[:cut]) + [half + i for i in _aligned(x[half:], y[cut:])]
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, v in enumerate(x.tolist()):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], (best[i, :-1] + 1) * (y == v)))
    out, i, j = [], len(x), len(y)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


def common(a: Sequence, b: Sequence) -> set[int]:
    """Places in `a` of lines of a longest common subsequence of `a` and `b`.

    What both begin and end with is matched at once; lines that only one has take no part.
    """
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    both = set(a[head : n - tail]) & set(b[head : m - tail])
    x = [i for i in range(head, n - tail) if a[i] in both]
    y = [j for j in range(head, m - tail) if b[j] in both]
    code = {t: k for k, t in enumerate(sorted(both))}
    middle = _aligned(np.array([code[a[i]] for i in x]), np.array([code[b[j]] for j in y]))
    return {*range(head), *range(n - tail, n), *[x[i] for i in middle]}


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Run(NamedTuple):
    """The pages of one path: the least and greatest hash of their html."""

    host: str
    path: str
    lo: int
    hi: int


def _behind(runs: list[Run], state: tuple[Run, ...] = ()) -> tuple[list[tuple[Run, ...]], tuple[Run, ...]]:
    """For each of `runs`, those before it that a page may be held against: the one just before and, for pages
    whose html is all that one has, the last one that has another. And the same for the run after the last;
    `state` is that of the runs which went before."""
    out = []
    for r in runs:
        if state and state[0].host != r.host:
            state = ()
        out.append(state)
        if not state or not r.lo == r.hi == state[0].lo == state[0].hi:
            state = (r, *state[:1])
        else:
            state = (r, *state[1:])
    return out, state


def _carried(edges: dict[int, tuple[Run, ...]], order: list[int]) -> dict[int, tuple[Run, ...]]:
    """What stands before each part, from what each leaves behind."""
    out, state = {}, ()
    for part in order:
        out[part] = state
        state = _behind(list(edges[part][::-1]), state)[1]
    return out


_RUNS = pa.list_(pa.struct([("path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))
_KEY = ["host", "path", "sig"]


def _per_part(batches: Iterator[pa.RecordBatch]) -> dict[int, list[Run]]:
    out: dict[int, list[Run]] = {}
    for batch in batches:
        for part, *r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            out.setdefault(part, []).append(Run(*r))
    return out


def near_runs(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, path, before, after): for each path of `keys` (host, path, sig) the runs of `_behind`, on either side; and the table it reads.

    Paths are dealt out by ranges, so that a host of any size spreads over tasks; a task holds the paths of its range.
    The driver sees four runs a range at most, and tells each task what lies beyond the edges of its own.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = keys.groupBy("host", "path").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"))
    runs = as_leaf(runs.repartitionByRange(n, "host", "path").select(F.spark_partition_id().alias("part"), "host", "path", "lo", "hi"))
    dealt = runs.repartitionById(n, "part").sortWithinPartitions("part", "host", "path")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _per_part(batches).items():
            found = [(part, last, *r) for last, x in ((True, own), (False, own[::-1])) for r in _behind(x)[1]]
            yield pa.RecordBatch.from_pylist([dict(zip(edge, r, strict=True)) for r in found], edge_schema)

    edge = ["part", "last", *Run._fields]
    edge_schema = pa.schema(list(zip(edge, [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)))
    first: dict[int, tuple[Run, ...]] = {}
    last: dict[int, tuple[Run, ...]] = {}
    for r in dealt.mapInArrow(ends, "part int, last boolean, host string, path string, lo long, hi long").collect():
        of = last if r["last"] else first
        of[r["part"]] = (*of.get(r["part"], ()), Run(*r[2:]))
    ahead, beyond = _carried(last, sorted(last)), _carried(first, sorted(first, reverse=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _per_part(batches).items():
            before, after = _behind(own, ahead[part])[0], _behind(own[::-1], beyond[part])[0][::-1]
            sides = [pa.array([[r[1:] for r in x] for x in side], _RUNS) for side in (before, after)]
            yield pa.RecordBatch.from_arrays([pa.array([r.host for r in own]), pa.array([r.path for r in own]), *sides], names=["host", "path", "before", "after"])

    side = "array<struct<path: string, lo: bigint, hi: bigint>>"
    return dealt.mapInArrow(run, f"host string, path string, before {side}, after {side}"), runs


def nearest(path: str, sig: int, before: list, after: list) -> tuple[str, int] | None:
    """(path, html's hash) of the page that one of `path` and `sig` is held against."""
    best, shared = None, -1
    for side, which in ((before, ("hi", "lo")), (after, ("lo", "hi"))):
        found = next(((r["path"], r[k]) for r in side or () for k in which if r[k] != sig), None)
        if found and (s := _shared(found[0], path)) > shared:
            best, shared = found, s
    return best


def lines_of(page: str) -> list[tuple[str, bool]]:
    """The blocks that can be the page's text: those of its articles, or of the whole page if it has none."""
    own = blocks(page)
    return [x for x in own if x[1]] or own


def hashed(lines: list[tuple[str, bool]]) -> list[int]:
    """Each line as a number, of which the lowest bit says that it lies in an article."""
    return [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) & ~1 | m for t, m in lines]


def hashes(pages: DataFrame) -> DataFrame:
    """(host, path, sig, own, every): the lines of each distinct page as numbers: those that can be its text, and all."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", SLICE):
                found = [blocks(x) for x in part.column(3).to_pylist()]
                own = [hashed([x for x in lines if x[1]] or lines) for lines in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(own, kind), pa.array(map(hashed, found), kind)], names=[*_KEY, "own", "every"])

    made = pages.select(*_KEY, "html").mapInArrow(run, "host string, path string, sig long, own array<bigint>, every array<bigint>")
    return as_leaf(made.groupBy(*_KEY).agg(F.first("own").alias("own"), F.first("every").alias("every")))


def site_lines(pages: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """(host, line) of the article lines in `shared` (host, line) that at least `least` paths, and SITE_SHARE, of their host have."""
    paths = pages.select("host", "path").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("paths"))
    some = shared.distinct()
    found = pages.select("host", "path", F.explode("own").alias("line")).join(some, ["host", "line"], "left_semi").distinct()
    return found.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).join(paths, "host").where((F.col("n") >= least) & (F.col("n") >= SITE_SHARE * F.col("paths"))).select("host", "line")


def deleted(pages: DataFrame, least: int) -> DataFrame:
    """(host, path, sig, gone) from the `hashes` of all pages: the places of the lines that differencing deletes, where there are any."""
    place = "array<struct<place: int, line: bigint>>"
    kind = pa.list_(pa.struct([("place", pa.int32()), ("line", pa.int64())]))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [nearest(*x) or (None, None) for x in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([p for p, _ in near], pa.string()), pa.array([g for _, g in near], pa.int64())], names=[*_KEY, "near_path", "near_sig"])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [[{"place": i, "line": a[i]} for i in sorted(common(a, b))] for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(same, kind)], names=[*_KEY, "same"])

    sides, runs = near_runs(pages.select(*_KEY))
    pairs = as_leaf(pages.select(*_KEY).join(sides, ["host", "path"]).select(*_KEY, "before", "after").mapInArrow(choose, "host string, path string, sig long, near_path string, near_sig long"))
    drop_leaf(runs)
    other = pages.select("host", F.col("path").alias("near_path"), F.col("sig").alias("near_sig"), F.col("every").alias("near"))
    both = pairs.where("near_path IS NOT NULL").join(other, ["host", "near_path", "near_sig"]).select(*_KEY, "near")
    both = both.join(pages.select(*_KEY, "own"), _KEY).select(*_KEY, "own", "near")
    same = as_leaf(both.mapInArrow(difference, f"host string, path string, sig long, same {place}").where(F.size("same") > 0))
    each = same.select(*_KEY, F.explode("same").alias("x")).select(*_KEY, F.col("x.place").alias("place"), F.col("x.line").alias("line"))
    inside = F.col("line").bitwiseAND(F.lit(1)) == 1
    site = as_leaf(site_lines(pages, each.where(inside).select("host", "line"), least))
    gone = each.where(~inside).union(each.where(inside).join(site, ["host", "line"], "left_semi").select(*each.columns))
    out = as_leaf(gone.groupBy(*_KEY).agg(F.collect_list("place").alias("gone")))
    drop_leaf(pairs, same, site)
    return out


def page_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html", site_paths: int = SITE_PATHS) -> DataFrame:
    """(page_id, url, text) for each row of `pages`.

    Null html gives an empty text. A null or odd URL has an empty host. Rows of equal host, path and html have
    equal texts, and which page one is held against depends on the pages alone; query strings are no part of the
    path. Html of any length is read in linear time; an alignment takes time by the product of the lines that two pages
    share and memory by their number. An empty table gives an empty result, and other columns are not looked at. Pages
    are held against each other by numbers for their lines, 16 bytes a line; html is joined with what is to be deleted.
    A line within an article goes if the nearest page has it and `site_paths` paths of the host do, and SITE_SHARE of them.
    """
    host, path = parts(F.col(f"`{url}`"))
    text = F.coalesce(F.col(f"`{source}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), host.alias("host"), path.alias("path"), F.xxhash64(text).alias("sig"), text.alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    found = hashes(rows)
    gone = deleted(found, site_paths)
    drop_leaf(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", SLICE):
                made = []
                for page, drop in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    away = set(drop or ())
                    made.append("\n".join(t for i, (t, _) in enumerate(lines_of(page)) if i not in away))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(made, pa.string())], names=["page_id", "url", "text"])

    both = rows.join(gone, _KEY, "left").select("page_id", "url", "html", "gone")
    return both.mapInArrow(run, f"page_id {kind}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
