"""Line-first cleaning, in DataFrame functions only.

Each line with a word is held against rules; lines that fail go; a document that loses too much of its
text goes as a whole. Counts over the whole document come first and can fail it by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents

#: Characters counted as symbols, and those that only end a sentence when they stand alone.
SYMBOLS, CRIES = "#*$%&|<>", "!?"
WHITE = "\t\n\x0b\f\r"
MIN_WORDS = 50
#: Percent of words in repeated three-word windows beyond which a document fails.
MAX_REPEATED = 50
#: Percent of words that the lines left must hold.
MIN_LEFT = 50
#: A line fails with more symbols, or more cries, than this percent of its words; a lone mark is let through.
MAX_MARKS = 30
#: A line of so many words fails if fewer than this percent of them differ.
LONG_LINE, MIN_DISTINCT = 12, 25
#: A line of at most so many words is navigation when a separator stands between its words.
NAV_WORDS, SEPARATORS = 12, (" | ", " > ", " » ", " · ", " • ", " / ", " :: ", " → ")
#: A line of at most so many words is boilerplate when it holds one of these, or ends in one of those.
BOILER_WORDS = 30
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "privacy policy", "terms of service", "terms of use", "lorem ipsum", "click here to subscribe", "sign up for our newsletter",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "conditions générales d", "activer javascript", "mentions légales",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "términos y condiciones", "activar javascript", "aviso legal",
)
#: Ends of lines that were cut off, in place of a sentence's end.
CUT_OFF = ("...", "…", "[…]", "[...]", "read more", "weiterlesen", "lire la suite", "leer más")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(c: Column) -> Column:
    return F.array_remove(F.split(F.translate(c, WHITE, " " * len(WHITE)), " "), "")


def _without(c: Column, chars: str) -> Column:
    return F.char_length(F.translate(c, chars, ""))


def _fails(x: Column) -> Column:
    """Whether a line's facts break a rule."""
    line, lower = x["line"], F.lower(x["line"])
    marks = lambda n: (n > 1) & (n * 100 > x["n"] * MAX_MARKS)
    holds = lambda texts, c: F.greatest(*[F.contains(c, F.lit(t)) for t in texts])
    navigation = (x["n"] <= NAV_WORDS) & holds(SEPARATORS, line)
    end = F.rtrim(F.translate(lower, WHITE, " " * len(WHITE)))
    boilerplate = (x["n"] <= BOILER_WORDS) & (holds(BOILERPLATE, lower) | F.greatest(*[F.endswith(end, F.lit(t)) for t in CUT_OFF]))
    return marks(x["symbols"]) | marks(x["cries"]) | ((x["n"] >= LONG_LINE) & (x["distinct"] * 100 < x["n"] * MIN_DISTINCT)) | navigation | boilerplate


def _guarded(c: Column) -> Column:
    """`c`, behind a row number that is never negative.

    The optimizer moves no filter below a column that isn't deterministic. Without it a filter on any of the results
    would repeat all that they are made of, many times over.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def quality_rules(docs: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with COUNTS, `base_failed`, `kept` and `clean_text` (its lines that pass, in order).

    Null and empty texts have no words and fail. Lines end at \\n only; a line without a word is neither
    judged nor removed. Columns of `docs` with the new names are replaced, all others pass through, and
    repeated rows are judged alike; an empty table stays empty. Everything is computed within a row: no shuffle, and
    what a task holds is one document's words, at about 200 bytes a word.
    """
    new = {*COUNTS, "base_failed", "kept", "clean_text"}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    pre = "__"
    while any(c.lower().startswith(pre) for c in docs.columns):
        pre += "_"
    lines, facts, words, size, windows, placed, at, good, counted, clean = (pre + c for c in ("lines", "facts", "words", "size", "windows", "placed", "at", "good", "counted", "clean"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*own, F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), _words(x).alias("w"))).alias(lines))
    rows = rows.select(
        *own,
        F.transform(lines, lambda x: F.struct(
            x["line"].alias("line"), F.size(x["w"]).alias("n"), F.size(F.array_distinct(x["w"])).alias("distinct"),
            (F.char_length(x["line"]) - _without(x["line"], SYMBOLS)).alias("symbols"), (F.char_length(x["line"]) - _without(x["line"], CRIES)).alias("cries"),
        )).alias(facts),
        F.flatten(f"{lines}.w").alias(words),
    )
    n = F.size(words)
    window = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.select(*own, facts, n.alias(size), F.slice(window, F.lit(1), F.greatest(n - 2, F.lit(0))).alias(windows))
    # Only documents in which a window comes back pay for finding where.
    again = F.size(F.array_distinct(windows)) < F.size(windows)
    sorted_windows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*own, facts, size, F.when(again, sorted_windows).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias(placed))
    beside = lambda x, j: F.coalesce(F.get(placed, j)["h"] == x["h"], F.lit(False))
    rows = rows.select(*own, facts, size, F.transform(F.filter(placed, lambda x, j: beside(x, j - 1) | beside(x, j + 1)), lambda x: x["i"]).alias(at), F.filter(facts, lambda x: ~((x["n"] > 0) & _fails(x))).alias(good))
    worded = F.transform(F.filter(facts, lambda x: x["n"] > 0), lambda x: x["line"])
    values = (
        F.col(size), _without(t, " " + WHITE), F.char_length(t) - _without(t, SYMBOLS), F.size(worded) - F.size(F.array_distinct(worded)),
        F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))), F.aggregate(good, F.lit(0), lambda a, x: a + x["n"]),
    )
    made = F.struct(*[v.cast("long").alias(c) for c, v in zip((*COUNTS, "left"), values, strict=True)])
    rows = rows.select(*own, _guarded(made).alias(counted), _guarded(F.array_join(F.transform(good, lambda x: x["line"]), "\n")).alias(clean))
    of = lambda c: F.col(counted)[c]
    failed = (of("n_words") < min_words) | (of("n_repeat_words") * 100 > of("n_words") * MAX_REPEATED)
    left = of("left") * 100 >= of("n_words") * MIN_LEFT
    return rows.select(*own, *[of(c).alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & left).alias("kept"), F.col(clean).alias("clean_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *COUNTS, "base_failed", "kept")


def judged_sql(table: str = "documents", min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for the query's columns and `clean_text`, over (doc_id, text) of `table`; doc_ids differ."""
    white = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    words = lambda c: f"list_filter(string_split(translate({c}, {white}, '     '), ' '), lambda x: x <> '')"
    less = lambda c, chars: f"(length({c}) - length(translate({c}, '{chars}', '')))"
    holds = lambda texts, c: "(" + " OR ".join(f"contains({c}, '{t}')" for t in texts) + ")"
    ends = "(" + " OR ".join(f"ends_with(rtrim(translate(lower(line), {white}, '     '), ' '), '{t}')" for t in CUT_OFF) + ")"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ln FROM d),
w AS (SELECT *, {words("line")} AS w FROM l),
f AS (SELECT *, len(w) AS n, len(list_distinct(w)) AS distinct_n, {less("line", SYMBOLS)} AS symbols, {less("line", CRIES)} AS cries FROM w),
g AS (SELECT *, n > 0 AND ((symbols > 1 AND symbols * 100 > n * {MAX_MARKS}) OR (cries > 1 AND cries * 100 > n * {MAX_MARKS})
  OR (n >= {LONG_LINE} AND distinct_n * 100 < n * {MIN_DISTINCT}) OR (n <= {NAV_WORDS} AND {holds(SEPARATORS, "line")})
  OR (n <= {BOILER_WORDS} AND ({holds(BOILERPLATE, "lower(line)")} OR {ends}))) AS bad FROM f),
a AS (SELECT doc_id, sum(n) AS n_words, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
  coalesce(sum(n) FILTER (NOT bad), 0) AS n_left, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT bad), '') AS clean_text FROM g GROUP BY doc_id),
p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {words("t")} AS ws FROM d)),
q AS (SELECT doc_id, i, a, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM q WHERE c IS NOT NULL),
s AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) o(k) WHERE times > 1 GROUP BY doc_id),
z AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(translate(t, ' '||{white}, '')) AS BIGINT) AS word_chars, CAST({less("t", SYMBOLS)} AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_left, clean_text
  FROM d JOIN a USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {min_words} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {min_words} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * n_left >= {MIN_LEFT} * n_words AS kept, clean_text FROM z
"""


SQL = f"SELECT doc_id, {', '.join(COUNTS)}, base_failed, kept FROM ({judged_sql()})"
