"""URL filters: rules by host and path first, then a naive Bayes verdict over segmented names.

Names in hosts and paths are split into words by unigram Viterbi: of all ways to cut a name into words, the
one whose words are likeliest together, where an unknown run of letters costs more the longer it is. What words
cost follows from words that stand apart already: those of all pages' texts, and parts of names with hyphens and the
like. A whole name isn't one of them, so that names which were written together are cut. The words that result are
scored by multinomial naive Bayes, fitted on URLs whose host holds a seed word or doesn't. The counts of words stay in
a table, and each distinct name is cut once, beside the costs of its own parts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import most
from quarry.plans.materialize import as_leaf, drop_leaf

#: (host, path, verdict) of the query's rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A host with one of these words is an example of an unwanted one; words of plain sites are known words from the start.
UNWANTED = "adserver ads adult bets betting casino cialis escort gambling jackpot keygen lottery malware payday phishing pills poker porn roulette scam slots spam viagra warez xxx".split()
PLAIN = "news blog home about wiki docs help support forum shop store book books library school university science health sport music film travel food garden house family city weather map history art law public press journal review guide learn open data code page pages article articles post posts story stories index search archive category product products".split()
#: How often a seed counts as a word, and in its class, at least.
SEED_COUNT = 20
#: The classifier is fitted on about so many URLs by hash; the default of a parameter of `train`.
EXAMPLES = 20_000
#: The scores of so many names, the most frequent ones, are known to all tasks; those of others are joined.
COMMON = 20_000
SHORTEST_WORD, SHORTEST_NAME = 2, 3
#: Scores are whole multiples of one in so many, so that their sums don't depend on the order.
UNIT = 1 << 40
#: Parts of hosts that say nothing.
SILENT = frozenset("www m com org net http https html htm php index example".split())


def parts(url) -> tuple:
    """Columns (host, path) of a column of URLs."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.when(has, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def names(host, path):
    """Column of a URL's runs of three letters or more; shorter ones are mostly language codes."""
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", host, path)), F.lit(f"([a-z]{{{SHORTEST_NAME},}})"))
    return F.filter(found, lambda w: ~w.isin(*SILENT))


def apart(pages: DataFrame, url: str, html: str | None) -> DataFrame:
    """(word): each occurrence of a word that stands apart, in texts or within a host's label or a path's segment that has several.

    Such a part of a label or segment isn't taken for a word if it looks written together itself: if it begins or
    ends with a longer word of UNWANTED.
    """
    host, path = parts(F.col(f"`{url}`"))
    whole = F.split(F.lower(F.concat_ws("/", host, path)), "[./]")
    runs = F.transform(whole, lambda x: F.regexp_extract_all(x, F.lit("([a-z]+)"), F.lit(1)))
    seed = "|".join(w for w in UNWANTED if len(w) > 3)
    found = F.filter(F.flatten(F.filter(runs, lambda x: F.size(x) > 1)), lambda x: ~x.rlike(f"^(?:{seed})[a-z]{{3}}|[a-z]{{3}}(?:{seed})$"))
    if html is not None:
        text = F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), "<[^<>]*>|&[A-Za-z0-9#]+;", " ")
        found = F.concat(found, F.split(F.lower(text), r"[^\p{L}]+"))
    return pages.select(F.explode(found).alias("word")).where(F.col("word").rlike(f"^[a-z]{{{SHORTEST_WORD},}}$"))


@dataclass
class Model:
    cost: dict[str, float]  #: of each known word, minus the logarithm of its share; `table` has those of a corpus
    unknown: float  #: of a letter of an unknown word
    score: dict[str, float]  #: log odds of unwanted; a word that training didn't see says nothing
    prior: float
    table: DataFrame | None = None  #: (word, cost)
    longest: int = 0  #: letters of the longest word in `table`

    def segment(self, name: str) -> list[str]:
        """The likeliest words of `name`, of equal ones those with the longest last. Letters between known words stay together as one unknown word."""
        n = len(name)
        sizes = sorted({len(w) for w in self.cost if len(w) <= n}, reverse=True)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        run, begin = math.inf, 0  # the cost where an unknown word ends here, and where that begins
        for end in range(1, n + 1):
            run, begin = min((run + self.unknown, begin), (best[end - 1] + 2 * self.unknown, end - 1))
            best[end], back[end] = run, begin
            for k in sizes:
                c = self.cost.get(name[end - k : end]) if k <= end else None
                if c is not None and best[end - k] + c < best[end]:
                    best[end], back[end] = best[end - k] + c, end - k
        out = []
        while n:
            out.append(name[back[n] : n])
            n = back[n]
        return out[::-1]

    def score_of(self, words: list[str]) -> int:
        """The log odds that `words` add, in UNITs."""
        return sum(round(self.score.get(w, 0.0) * UNIT) for w in words)


def segmented(found: DataFrame, model: Model) -> DataFrame:
    """(name, words) for each row of `found` (name), whose names differ.

    Each name's parts, as long as the longest known word at most, meet the table of costs by shuffle, so that neither
    has to fit in a task.
    """
    numbered = as_leaf(found.select(F.monotonically_increasing_id().alias("id"), "name"))
    longest, unknown = model.longest, model.unknown

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["id", "word"])

        ids, words = [], []
        for batch in batches:
            for i, name in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for at in range(len(name)):
                    own = [name[at:end] for end in range(at + SHORTEST_WORD, min(len(name), at + longest) + 1)]
                    ids += [i] * len(own)
                    words += own
                    if len(ids) > 100_000:
                        yield made()
                        ids, words = [], []
        yield made()

    costs = F.collect_set(F.struct("word", "cost")).alias("known")
    met = numbered.mapInArrow(cut, "id long, word string").join(model.table, "word").groupBy("id").agg(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(name, Model({x["word"]: x["cost"] for x in known or ()}, unknown, {}, 0.0).segment(name)) for name, known in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.list_(pa.string()))], names=["name", "words"])

    both = numbered.join(met, "id", "left").select("name", "known")
    return both.mapInArrow(run, "name string, words array<string>").select("name", F.filter("words", lambda w: ~w.isin(*SILENT)).alias("words"))


def train(pages: DataFrame, *, url: str = "url", html: str | None = "html", examples: int = EXAMPLES) -> Model:
    """From the seed words, how often words stand apart in all `pages`, and about `examples` URLs, a sample by hash.

    A URL whose host has a word of UNWANTED, once it is cut, is an example of an unwanted one, any other of the
    rest; from all words of the host and the path the classifier learns what stands beside the seeds. Counts of
    the sample's distinct words reach the driver. Without rows only the seeds are known.
    """
    spark = pages.sparkSession
    counts = as_leaf(apart(pages, url, html).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    seeds = sorted({*UNWANTED, *PLAIN})
    size, total, longest = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.length("word")), F.lit(0))).first()
    mean = max(SEED_COUNT, total // max(1, size))
    total += mean * len(seeds)
    first = spark.createDataFrame([(w, mean) for w in seeds], "word string, n long")
    both = counts.union(first).groupBy("word").agg(F.sum("n").alias("n"))
    table = as_leaf(both.select("word", (-F.log(F.col("n") / F.lit(float(total)))).alias("cost")))
    drop_leaf(counts)
    model = Model({}, math.log(30.0), {}, 0.0, table, max(longest, *map(len, seeds)))
    host, path = parts(F.col(f"`{url}`"))
    rate = min(1.0, examples / max(1, pages.count()))
    urls = pages.select(host.alias("host"), path.alias("path"), F.xxhash64(F.col(f"`{url}`"), F.lit(3)).alias("draw"))
    sample = urls.where(F.pmod("draw", F.lit(1 << 30)) < rate * float(1 << 30))
    sample = as_leaf(sample.select(names("host", F.lit("")).alias("host"), names(F.lit(""), "path").alias("path")).withColumn("id", F.monotonically_increasing_id()))
    cuts = as_leaf(segmented(sample.select(F.explode(F.concat("host", "path")).alias("name")).distinct(), model))
    found = sample.select("id", F.explode(F.transform("host", lambda x: F.struct(x.alias("name"), F.lit(True).alias("in_host")))).alias("x"))
    found = found.union(sample.select("id", F.explode(F.transform("path", lambda x: F.struct(x.alias("name"), F.lit(False).alias("in_host"))))))
    words = as_leaf(found.select("id", "x.*").join(cuts, "name").select("id", "in_host", F.explode("words").alias("word")))
    bad = words.where(F.col("in_host") & F.col("word").isin(*UNWANTED)).select("id").distinct()
    of_class = words.join(bad.withColumn("bad", F.lit(True)), "id", "left").groupBy(F.coalesce("bad", F.lit(False)).alias("bad"), "word").agg(F.count(F.lit(1)).alias("n")).collect()
    docs = {True: 1 + bad.count()}
    docs[False] = 2 + sample.count() - docs[True]
    drop_leaf(sample, cuts, words)
    model.score, model.prior = odds_of({k: Counter({r["word"]: r["n"] for r in of_class if r["bad"] == k}) for k in (True, False)}, docs)
    return model


def odds_of(seen: dict[bool, Counter], docs: dict[bool, int]) -> tuple[dict[str, float], float]:
    """(log odds of each word, log odds of a URL without words) from counts of words and URLs by class, and the seeds."""
    seen = {k: seen[k] + Counter(dict.fromkeys(own, SEED_COUNT)) for k, own in ((True, UNWANTED), (False, PLAIN))}
    vocabulary = set(seen[True]) | set(seen[False])
    size = {k: sum(c.values()) + len(vocabulary) for k, c in seen.items()}
    return {w: math.log((seen[True][w] + 1) / size[True]) - math.log((seen[False][w] + 1) / size[False]) for w in vocabulary}, math.log(docs[True] / docs[False])


def matching(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """(rule, its verdict): of the rules of the host and all it is a subdomain of, the longest that fits."""
    best, at = None, host
    while at:
        for start, verdict in rules.get(at, ()):
            if path.startswith(start) and (best is None or len(at + start) > len(best[0])):
                best = (at + start, verdict)
        at = at.partition(".")[2]
    return best


def scored(found: DataFrame, model: Model) -> DataFrame:
    """(name, score): what each of `found` (name), whose names differ, adds to the odds, in UNITs."""
    bare = Model({}, model.unknown, model.score, model.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bare.score_of(w) for w in batch.column(1).to_pylist()], pa.int64())], names=["name", "score"])

    return segmented(found, model).mapInArrow(run, "name string, score long")


def url_filter(pages: DataFrame, model: Model, *, rules=RULES, key: str = "page_id", url: str = "url", common: int = COMMON) -> DataFrame:
    """(page_id, host, path, rule, verdict, odds) for each row of `pages`.

    A null URL or one without :// has an empty host and path and is let through unless the prior alone says
    otherwise. `rule` is null where none fits and the model decided. Equal rules: the later one is not used.
    Rows that repeat are judged alike; an empty table gives an empty result, and other columns are not looked at. URLs
    of any length are judged whole. Rules and the scores of up to `common` names, the most frequent ones, go to every task;
    where there are more names, the others' scores are joined to numbered rows, without their html.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    host, path = parts(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("names", names("host", "path"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, odds double"
    counts = as_leaf(rows.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    scores = as_leaf(scored(counts.select("name"), model))
    known = {r["name"]: r["score"] for r in scores.join(most(counts, "n", common), "name").select("name", "score").collect()}
    if counts.count() > len(known):
        top = as_leaf(most(counts, "n", common).select("name"))
        numbered = as_leaf(rows.withColumn("row", F.monotonically_increasing_id()))
        rare = numbered.select("row", F.explode("names").alias("name")).join(F.broadcast(top), "name", "left_anti")
        sums = rare.join(scores, "name").groupBy("row").agg(F.sum("score").alias("rest"))
        rows = numbered.join(sums, "row", "left").select("page_id", "host", "path", "names", F.coalesce("rest", F.lit(0)).alias("rest"))
    else:
        drop_leaf(scores)
        rows = rows.withColumn("rest", F.lit(0).cast("long"))
    drop_leaf(counts)
    prior = round(model.prior * UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for h, p, own, rest in zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True):
                rule = matching(by_host, h, p)
                odds = (prior + rest + sum(known.get(x, 0) for x in own)) / UNIT
                made.append((rule[0] if rule else None, rule[1] if rule else "block" if odds > 0 else "allow", odds))
            cols = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "odds"])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, train(pages)).select("page_id", "host", "path", "rule", "verdict")
