"""Exact n-gram Jaccard self-join by prefixes under several global orders, and the groups it forms.

Two sets as similar as asked share tokens among the first few of each, whatever order all tokens are put
in. The first order puts tokens that many documents have last, so that the prefixes hold rare ones; an index
over those prefixes gives candidates. The other orders are unrelated ones, by hash: a candidate pair stays only
if its prefixes share enough tokens under each of them. Only pairs that pass all filters have their texts fetched
and are verified on the whole sets.

Documents with equal sets are one class. Within an index entry not all pairs are made: first each class meets
the entry's hub, the class in which the token stands earliest. Then only classes that the links found so far
leave in different groups meet, and only where similar sets may have their first token in common. If there
are too many such pairs, the tokens with most of them count as frequent, and the index is built again under
that order. The result is that of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bitmap, documents, hits, most, slices, slot
from quarry.llm.components import components
from quarry.llm.shingles import mix, sets, signature
from quarry.plans.materialize import as_leaf, drop_leaf

SLICE = 2 << 20
#: A token in so many different sets among a task's next COUNTED bytes of text is reported; the MOST_FREQUENT reported
#: most are known to all tasks (16 bytes each).
REPORTED, COUNTED, MOST_FREQUENT = 2, 24 << 20, 500_000
#: More candidate pairs than this for each class and the index is built again, with the tokens that cause most
#: of them last; after REBUILDS of those all pairs are verified, however many.
PAIRS_A_CLASS, REBUILDS = 50, 2
#: A pair's filters ask for one token in common, and one more for each so many tokens of the smaller set.
FILTER_STEP = 4
#: Bits of the bitmap of tokens that several classes have: 8 MB, at any number of them.
TOKEN_BITS = 1 << 26
#: Rows with the texts of a hub and of so many classes it meets, or fewer, are verified by one task.
SPOKES = 128


@dataclass(frozen=True)
class Spec:
    """Words a shingle, the least similarity in percent, and how many token orders must agree."""

    width: int = 4
    percent: int = 85
    orders: int = 3

    def prefix(self, n: int) -> int:
        """How many of a set's n tokens, in any order, hold one in common with every similar set."""
        return n - -(-self.percent * n // 100) + 1

    def least(self, n: int) -> int:
        """How many tokens a set of n shares at least with a similar one in `long_prefix` of both, if that is no larger."""
        return min(1 + n // FILTER_STEP, -(-self.percent * n // 100))

    def long_prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + self.least(n)

    def needed(self, na: Column, nb: Column) -> Column:
        """The least number of tokens in common of similar sets of na and nb."""
        return F.ceil(self.percent * (na + nb) / (100.0 + self.percent) - 1e-9)

    def linked(self, both: int, either: int) -> bool:
        return 100 * both >= self.percent * either


class Order:
    """The first total order of all tokens: by how often they were reported, then by a hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.counts = tokens[at], counts[at]

    def first(self, own: np.ndarray, p: int) -> np.ndarray:
        """The first `p` of the set `own`."""
        h = mix(own)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
            rank = np.where(self.tokens[at] == own, self.counts[at], 0)
            return own[np.lexsort((h, rank))[:p]]
        return own[np.argsort(h)[:p]]


def head(own: np.ndarray, p: int, order: int) -> np.ndarray:
    """The first `p` tokens of the set `own` in another order, by the lower 16 bits of their hash.

    Tokens in common stay in common, so that what is lost of a hash can only let more pairs through.
    """
    h = mix(own, order)
    return (np.partition(h, p - 1)[:p] if p < len(h) else h).astype(np.uint16)


def may_match(spec: Spec, na: int, nb: int, a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> bool:
    """Whether the heads of two sets of na and nb share enough tokens under every order."""
    least = min(spec.least(na), spec.least(nb))
    return all(int(np.isin(x, y).sum()) >= least for x, y in zip(a, b, strict=True))


def scan(docs: DataFrame, key: str, text: str, spec: Spec) -> DataFrame:
    """(doc_id, n, sig, token): a row a document with its set's size and identity (null if it is empty), and
    rows of null `sig` with a `token` and how many of a task's sets have it."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kinds = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "sig", "token")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        held = 0

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(list(once.values())), return_counts=True)
            tokens, counts = tokens[counts >= REPORTED], counts[counts >= REPORTED]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(counts, pa.int64()), none, pa.array(tokens.view(np.int64))], schema=kinds)

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = sets(part.column(1).to_pylist(), spec.width)
                sigs = [signature(s) if len(s) else None for s in found]
                none = pa.nulls(len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, found), pa.int64()), pa.array(sigs, pa.int64()), none], schema=kinds)
                once.update((g, s) for g, s in zip(sigs, found, strict=True) if g is not None)
                held += sum(map(len, found))
                if held * 6 >= COUNTED:  # a token stands for about so many bytes
                    yield report()
                    once, held = {}, 0
        if once:
            yield report()

    return as_leaf(rows.mapInArrow(run, "doc_id long, n long, sig long, token long"))


def frequent(reports: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of (token, n) that are reported most, with their sums, MOST_FREQUENT at most. Which ones are left
    out changes the order, never the result."""
    sums = as_leaf(reports.groupBy("token").agg(F.sum("n").alias("n")))
    top = most(sums, "n", MOST_FREQUENT).toArrow()
    drop_leaf(sums)
    return top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()


def index(docs: DataFrame, text: str, spec: Spec, order: Order) -> DataFrame:
    """(token, sig, n, pos) for each token in the prefix of each class; a task gives each class once."""
    kinds = pa.schema([("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                tokens, sigs, sizes, at = [], [], [], []
                for own in sets(part.column(0).to_pylist(), spec.width):
                    if len(own) and (sig := signature(own)) not in seen:
                        seen.add(sig)
                        first = order.first(own, spec.prefix(len(own)))
                        tokens.append(first)
                        sigs.append(np.full(len(first), sig))
                        sizes.append(np.full(len(first), len(own), np.int32))
                        at.append(np.arange(len(first), dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in tokens], sigs, sizes, at)], schema=kinds)

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "token long, sig long, n int, pos int")


#: An entry's place and class in one number: the place above, the upper bits of the class below.
CLASS_BITS = 44


def _upper(sig: Column) -> Column:
    return F.shiftrightunsigned(sig, 64 - CLASS_BITS)


def _early(spec: Spec, n: Column, pos: Column, other: Column) -> Column:
    """Whether the first token that similar sets of n and `other` have in common may stand at this place."""
    return pos <= n - spec.needed(n, other)


def entries(rows: DataFrame, spec: Spec) -> DataFrame:
    """(token, sig, n, pos, hub, hub_pos) of tokens that more than one class has, as far as they stand early
    enough to matter. `hub` is the upper bits of the class in which the token stands earliest. A token's rows
    are combined map-side to three numbers. Most tokens are one class's alone; the others' bitmap keeps nearly all rows of
    those out of the join. A token goes unseen where all classes that have it agree in those bits and
    have it at the same place: a chance of 2^-44 a token.
    """
    last = (1 << (63 - CLASS_BITS)) - 1
    place = F.shiftleft(F.least("pos", F.lit(last)).cast("long"), CLASS_BITS).bitwiseOR(_upper(F.col("sig")))
    seen = rows.groupBy("token").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.min("n").alias("least")).where("lo <> hi")
    hub = F.col("lo").bitwiseAND(F.lit((1 << CLASS_BITS) - 1))
    seen = as_leaf(seen.select("token", hub.alias("hub"), F.shiftright("lo", CLASS_BITS).alias("hub_pos"), "least"))
    bits = bitmap(seen.select((F.col("token").bitwiseAND(F.lit(TOKEN_BITS - 1)) + 1).alias("slot")), TOKEN_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(bits, (batch.column(0).to_numpy() & (TOKEN_BITS - 1)) + 1)))

    met = rows.mapInArrow(run, "token long, sig long, n int, pos int").join(seen, "token")
    smallest = F.greatest(F.col("least"), F.ceil(spec.percent * F.col("n") / 100.0 - 1e-9))
    out = as_leaf(met.where(_early(spec, F.col("n"), F.col("pos"), smallest)).select("token", "sig", "n", "pos", "hub", "hub_pos"))
    drop_leaf(seen)
    return out


def star_pairs(found: DataFrame, classes: DataFrame, spec: Spec) -> DataFrame:
    """(a, b): classes with the hubs of their entries, where similar sets may first meet there."""
    hubs = classes.select(F.col("sig").alias("other"), F.col("n").alias("m"), _upper(F.col("sig")).alias("hub"))
    n, m = F.col("n"), F.col("m")
    met = found.join(hubs, "hub").where("sig <> other")
    met = met.where((100 * F.least(n, m) >= spec.percent * F.greatest(n, m)) & _early(spec, n, F.col("pos"), m) & _early(spec, m, F.col("hub_pos"), n))
    return met.select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b")).distinct()


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries' rows but the hubs', which have met all others of their entry, with the group of each class."""
    other = labels.select(F.col("node").alias("sig"), "label")
    return found.where(_upper(F.col("sig")) != F.col("hub")).join(other, "sig", "left").select("token", "sig", "n", "pos", F.coalesce("label", "sig").alias("label"))


def open_entries(rows: DataFrame) -> DataFrame:
    """(token, pairs) of entries with classes of different groups, with how many such pairs they have."""
    each = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    sums = each.groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return sums.where("s * s > q").select("token", ((F.col("s") * F.col("s") - F.col("q")) / 2).cast("long").alias("pairs"))


def cross_pairs(rows: DataFrame, opened: DataFrame, spec: Spec) -> DataFrame:
    """(a, b): classes of different groups that have a token where similar sets may first meet."""
    own = rows.join(opened.select("token"), "token", "left_semi")
    side = lambda p: own.select("token", *[F.col(c).alias(f"{p}_{c}") for c in ("sig", "n", "pos", "label")])
    a, b = F.col("a_n"), F.col("b_n")
    can = (F.col("a_sig") < F.col("b_sig")) & (F.col("a_label") != F.col("b_label")) & (100 * F.least(a, b) >= spec.percent * F.greatest(a, b))
    met = side("a").join(side("b"), "token").where(can & _early(spec, a, F.col("a_pos"), b) & _early(spec, b, F.col("b_pos"), a))
    return met.select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b")).distinct()


def fetched(docs: DataFrame, key: str, text: str, spec: Spec, classes: DataFrame, wanted: DataFrame, kind: str, make: Callable[[np.ndarray, str], object]) -> DataFrame:
    """(sig, made): what `make` gives, of the type `kind`, for the set and text of each class in `wanted` (sig), and of some more.

    A class is fetched by its smallest id, or where none has an id from the rows without one. All tasks know the ids by
    their bitmap, and what it lets through beside the wanted goes in a later join. Nothing else is shuffled.
    """
    kinds = pa.schema([("sig", pa.int64()), ("made", pa.string() if kind == "string" else pa.binary())])
    reps = as_leaf(classes.join(wanted, "sig").select(F.col("least").alias("id")))
    bits = bitmap(reps.where("id IS NOT NULL").select(slot(F.col("id")).alias("slot")))
    nulls = not reps.where("id IS NULL").isEmpty()
    drop_leaf(reps)
    k = F.col(f"`{key}`").cast("long")
    rows = docs.select(F.when(k.isNull(), F.lit(0).cast("long")).otherwise(slot(k)).alias("slot"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own = batch.column(0).to_numpy()
            keep = np.where(own == 0, nulls, hits(bits, own))
            for part in slices(batch.filter(pa.array(keep)), "text", SLICE):
                own = part.column(1).to_pylist()
                out: dict[int, object] = {}
                for t, s in zip(own, sets(own, spec.width), strict=True):
                    if len(s) and (g := signature(s)) not in seen:
                        seen.add(g)
                        out[g] = make(s, t)
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), kinds[1].type)], schema=kinds)

    return rows.mapInArrow(run, f"sig long, made {kind}")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()


def filtered(pairs: DataFrame, docs: DataFrame, key: str, text: str, spec: Spec, classes: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose prefixes share enough tokens under every order but the first."""

    def heads(own: np.ndarray, _: str) -> bytes:
        p = spec.long_prefix(len(own))
        return np.array([len(own)], np.int64).tobytes() + b"".join(head(own, p, k).tobytes() for k in range(1, spec.orders))

    known = as_leaf(fetched(docs, key, text, spec, classes, _both(pairs), "binary", heads).groupBy("sig").agg(F.first("made").alias("made")))
    side = lambda c: known.select(F.col("sig").alias(c), F.col("made").alias(f"{c}_head"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_head", "b_head")
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                na, nb = (int.from_bytes(v[:8], "little") for v in (x, y))
                keep.append(may_match(spec, na, nb, *[np.frombuffer(v[8:], np.uint16).reshape(spec.orders - 1, -1) for v in (x, y)]))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=kinds).filter(pa.array(keep, pa.bool_()))

    # A class may have very many pairs: the joins read a table on either side, so that a large partition can be split.
    out = as_leaf(met.mapInArrow(run, "a long, b long"))
    drop_leaf(known)
    return out


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, spec: Spec, classes: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) that are linked, from the whole sets.

    Of each pair the class with more pairs is the hub. Its pairs are dealt out in groups of SPOKES; a group's task gets
    the hub's text once and then one text a pair, of which it holds one slice at a time.
    """
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))
    degree = as_leaf(ends.groupBy("sig").agg(F.count(F.lit(1)).alias("d")))
    of = lambda c: degree.select(F.col("sig").alias(c), F.col("d").alias(f"{c}_d"))
    first = F.struct(F.col("a_d").alias("d"), F.col("a").alias("sig")) >= F.struct(F.col("b_d").alias("d"), F.col("b").alias("sig"))
    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("spoke"), F.greatest("a_d", "b_d").alias("d"))
    dealt = as_leaf(dealt.select("hub", F.pmod(F.xxhash64("spoke"), F.ceil(F.col("d") / SPOKES)).alias("part"), "spoke"))
    needs = dealt.select("hub", "part").distinct().select("hub", "part", F.lit(False).alias("meets"), F.col("hub").alias("sig")).union(dealt.select("hub", "part", F.lit(True), "spoke"))
    texts = fetched(docs, key, text, spec, classes, degree.select("sig"), "string", lambda _, t: t)
    texts = texts.groupBy("sig").agg(F.first("made").alias("text"))
    rows = needs.join(texts, "sig").select("hub", "part", "meets", "sig", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "meets")
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                a, b = [], []
                columns = [part.column(i).to_pylist() for i in range(4)]
                for h, k, meets, sig, s in zip(*columns, sets(part.column(4).to_pylist(), spec.width), strict=True):
                    if not meets:
                        hub, own = (h, k), s
                    elif hub != (h, k):
                        raise RuntimeError("a hub's text is missing; the documents changed between two scans")
                    else:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if spec.linked(both, len(own) + len(s) - both):
                            a.append(min(h, sig))
                            b.append(max(h, sig))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=kinds)

    out = as_leaf(rows.mapInArrow(run, "a long, b long"))
    drop_leaf(degree, dealt)
    return out


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", spec: Spec = Spec()) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id) for each row of `docs`.

    Rows with equal sets, and rows whose sets are similar, are linked; component_id is the smallest id that
    links reach (null ids don't count unless there is no other). Rows without a word have no shingles and are
    alone: component_id is their own id. Repeated rows and repeated ids are rows of their own. An empty table gives
    an empty result. Texts of any length are read whole, in bounded pieces; what a task holds of one text grows by its
    words, at about 50 bytes each. Two different sets are taken for equal with a chance of 2^-64 a pair, and a
    token that two classes share is missed with a chance of 2^-44. Other columns are not looked at.
    """
    seen = scan(docs, key, text, spec)
    members = as_leaf(seen.where("token IS NULL").select("doc_id", "n", "sig"))
    tokens, counts = frequent(seen.where("token IS NOT NULL").select("token", "n"))
    drop_leaf(seen)
    classes = as_leaf(members.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")))
    n_classes = classes.count()

    def links_of(pairs: DataFrame) -> DataFrame:
        left = filtered(pairs, docs, key, text, spec, classes) if spec.orders > 1 else pairs
        out = verified(left, docs, key, text, spec, classes)
        if left is not pairs:
            drop_leaf(left)
        return out

    tried, links = [], []
    every = lambda tables: reduce(DataFrame.union, tables)
    for again in range(REBUILDS + 1):
        rows = as_leaf(index(docs, text, spec, Order(tokens, counts)))
        found = entries(rows, spec)
        drop_leaf(rows)
        pairs = star_pairs(found, classes, spec)
        tried.append(as_leaf(pairs.join(every(tried), ["a", "b"], "left_anti") if tried else pairs))
        links.append(links_of(tried[-1]))
        labels = components(every(links))
        rows = as_leaf(labelled(found, labels))
        opened = as_leaf(open_entries(rows))
        drop_leaf(found)
        total = opened.agg(F.sum("pairs")).first()[0] or 0
        if total <= PAIRS_A_CLASS * n_classes or again == REBUILDS:
            break
        more = most(opened, "pairs", MOST_FREQUENT // 10).toArrow()
        drop_leaf(rows, opened, labels)
        known = dict(zip(tokens.tolist(), counts.tolist(), strict=True))
        least = max(known.values(), default=0)
        for t, c in zip(more["token"].to_numpy().view(np.uint64).tolist(), more["pairs"].to_pylist(), strict=True):
            known[t] = max(known.get(t, 0), least + 1 + int(c).bit_length())
        tokens, counts = np.fromiter(known, np.uint64, len(known)), np.fromiter(known.values(), np.int64, len(known))
    if total:
        rest = as_leaf(cross_pairs(rows, opened, spec).join(every(tried), ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            links.append(links_of(rest))
            drop_leaf(labels)
            labels = components(every(links))
        drop_leaf(rest)
    drop_leaf(rows, opened, *tried, *links)
    own = as_leaf(classes.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").select("sig", "least", F.coalesce("label", "sig").alias("label")))
    drop_leaf(classes, labels)
    groups = as_leaf(own.groupBy("label").agg(F.min("least").alias("component_id")))
    named = as_leaf(own.join(groups, "label").select("sig", "component_id"))
    drop_leaf(own, groups)
    return members.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def joined_sql(table: str = "documents", spec: Spec = Spec()) -> str:  # noqa: B008
    """DuckDB SQL for the query's columns over `table`; its doc_ids differ and aren't null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gram = ", ".join(f"ws[i + {k}]" for k in range(spec.width))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(translate(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS ws FROM {table}),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(concat_ws(' ', {gram})) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {spec.width - 1}, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {spec.percent} * (na.n + nb.n - c)),
r AS (SELECT a AS doc_id, b AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reach) AS m FROM r GROUP BY doc_id) m USING (doc_id)
"""


SQL = joined_sql()
