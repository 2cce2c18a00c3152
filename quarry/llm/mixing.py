"""Mixing sources to target weights by exponential keys.

A source's target is met by complete epochs of all its documents first; what remains is a weighted sample
without replacement: each document draws an exponential key divided by its quality weight, and documents
are taken in key order until their words reach what remains.

The prefix sums are never taken over a whole source. Keys are cut into 64 bins a level; each level sums
words by (source, bin), which combines map-side, and looks further only into the bin where a source's
remainder ends. One cut per source comes out, against which every row is compared where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents
from quarry.plans.materialize import as_leaf, drop_leaf

#: Weights of the sources in code point order, null last, over and over.
WEIGHTS = (5, 2, 1)
#: Percent of all words that the mix takes, and how often a source may be taken.
SHARE, MOST = 150, 2
SEED = "mix"
BINS, LEVELS = 64, 3
#: Up to so many sources their cuts (four numbers each) are broadcast; beyond, the cluster joins them.
BROADCAST_SOURCES = 10_000
#: Marks that lower a document's quality weight, and the least weight.
MARKS, LEAST = "#*$%&|<>!", 0.1


def words(text: Column) -> Column:
    """How many runs of other than blank, tab and line ends there are; 0 for null."""
    bare = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.array_remove(F.split(bare, " "), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to LEAST the more of its characters are MARKS."""
    t = F.coalesce(text, F.lit(""))
    marks = F.char_length(t) - F.char_length(F.translate(t, MARKS, ""))
    return F.greatest(F.lit(LEAST), 1.0 - 10.0 * marks / F.greatest(F.char_length(t), F.lit(1)))


def draw(key: Column, text: Column, weight: Column, seed: str = SEED) -> Column:
    """The document's exponential key over its weight, brought into (0, 1) in the same order.

    The uniform number behind it comes from a hash of seed, id and text: the same on every run.
    """
    said = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(said, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    e = -F.ln(u) / weight
    return e / (1.0 + e)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with `target`: the share of all words by weight, none above MOST times its size.

    The excess of those at their limit is shared among the rest by weight, until none is above: with the
    sources in order of limit over weight, the first k are at their limit where the level that the others
    reach says so. Windows run over one row a source.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    rows = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((n - 1) % len(WEIGHTS) + 1).cast("int")).alias("w"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * (SHARE / 100.0)
    rest = budget - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(MOST)
    rows = rows.withColumn("level", rest / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # From the first source on that the level leaves below its limit, all share that level.
    rows = rows.withColumn("level", F.min(F.when(F.col("w") * F.col("level") < F.col("source_size") * float(MOST), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull().alias("z"), F.col("source"), F.col("level").alias("level")))).over(every)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("w") * F.col("level"), F.col("source_size") * float(MOST)), F.col("source_size") * float(MOST)).alias("target"))


def cuts(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, edge, last) from (source, size, key) of all documents.

    Beyond the complete epochs a source takes the documents with key < edge or key <= last.
    """
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = as_leaf(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("bin", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long")))
    n, width = state.count(), 1
    for _ in range(LEVELS):
        inside = _meet(rows, state, n).where(F.floor(F.col("key") * float(width)) == F.col("bin"))
        width *= BINS
        sums = inside.groupBy("source", F.floor(F.col("key") * float(width)).cast("long").alias("b")).agg(F.sum("size").alias("mass"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        upto = F.col("base") + F.sum("mass").over(Window.partitionBy("source").orderBy("b"))
        found = sums.withColumn("upto", upto).where((F.col("upto") - F.col("mass") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        step = found.select(F.col("source").alias("s"), F.col("b"), (F.col("upto") - F.col("mass")).alias("start"))
        further = as_leaf(state.join(step, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "rest", F.coalesce("b", F.lit(-1)).cast("long").alias("bin"), F.coalesce("start", F.lit(0)).cast("long").alias("base")))
        drop_leaf(state)
        state = further
    inside = _meet(rows, state, n).where(F.floor(F.col("key") * float(width)) == F.col("bin"))
    # The one that lies across the end is taken if more than half of it lies within.
    peers = inside.groupBy("source", "key").agg(F.sum("size").alias("mass"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    upto = F.col("base") + F.sum("mass").over(Window.partitionBy("source").orderBy("key"))
    taken = peers.withColumn("upto", upto).where(2 * F.col("upto") - F.col("mass") <= 2 * F.col("rest")).groupBy(F.col("source").alias("s")).agg(F.max("key").alias("last"))
    out = as_leaf(state.join(taken, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", F.when(F.col("bin") >= 0, F.col("bin") / float(width)).otherwise(0.0).alias("edge"), F.coalesce("last", F.lit(-1.0)).alias("last")))
    drop_leaf(state)
    return out


def _meet(rows: DataFrame, small: DataFrame, n: int) -> DataFrame:
    """`rows` with the columns of their source's row in `small`, which has `n` rows."""
    other = small.select(F.col("source").alias("__s"), *[c for c in small.columns if c != "source"])
    other = F.broadcast(other) if n <= BROADCAST_SOURCES else other
    return rows.join(other, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """(row, size, source_size, target, taken, copies): `row` is the document's row as a struct.

    `copies` is how often the mix takes the whole document, `taken` that many times its words. Each
    source's sum of `taken` differs from its `target` by half a document at most (rows equal in id and
    text count as one). Null sources are a source of their own, the last; null and empty texts have no words
    and are taken with complete epochs only. Texts of any length count whole, and an empty table gives an empty mix.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = docs.select(own.alias("row"), F.col(f"`{source}`").alias("source"), words(t).alias("size"), draw(k, t, quality_weight(t) if weight is None else weight).alias("key"))
    sizes = as_leaf(rows.select("source", "size", "key"))
    cut = cuts(sizes)
    drop_leaf(sizes)
    joined = _meet(rows, cut, cut.count())
    more = ((F.col("key") < F.col("edge")) | (F.col("key") <= F.col("last"))) & (F.col("size") > 0)
    copies = F.col("epochs") + more.cast("long")
    return joined.select("row", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def mixed_sql(table: str = "documents") -> str:
    """DuckDB SQL for doc_id, size, source_size, target, taken and copies over `table`."""
    bare = "translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     ')"
    marks = f"(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{MARKS}', '')))"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split({bare}, ' '), lambda x: x <> '')) AS BIGINT) AS size,
  greatest({LEAST}::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE * {marks} / greatest(length(coalesce(text, '')), 1)) AS q,
  (CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / {2**48}::DOUBLE AS u FROM {table}),
k AS (SELECT *, (-ln(u) / q) / (1.0::DOUBLE + (-ln(u) / q)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, ([{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1] AS w FROM s),
l AS (SELECT *, row_number() OVER o AS rn, ((sum(source_size) OVER ())::BIGINT * {SHARE / 100}::DOUBLE - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * {MOST}::DOUBLE)
  / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w WINDOW o AS (ORDER BY source_size / w, source IS NULL, source)),
f AS (SELECT arg_min(level, rn) AS level FROM l WHERE w * level < source_size * {MOST}::DOUBLE),
t AS (SELECT source, source_size, coalesce(least(w * (SELECT level FROM f), source_size * {MOST}::DOUBLE), source_size * {MOST}::DOUBLE) AS target FROM w),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(size) OVER (PARTITION BY k.source ORDER BY key RANGE UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER (PARTITION BY k.source, key)::BIGINT AS mass
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
m AS (SELECT *, epochs + CASE WHEN size > 0 AND 2 * upto - mass <= 2 * rest THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM m
"""


SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({mixed_sql()})"
