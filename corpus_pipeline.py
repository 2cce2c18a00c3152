"""From raw documents to token ids: quality rules, language, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. A stage that only drops
or repeats documents returns the columns it got; quality rules also put the cleaned text, and its length, in
place of the raw one. Columns beyond those of `documents` pass through. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bpe_codec import digests, encode_decode
from quarry.llm.common import may_be_in
from quarry.llm.jaccard_join import Spec, jaccard_join
from quarry.llm.language_id import identify, train
from quarry.llm.mixing import mix
from quarry.llm.quality_rules import quality_rules
from quarry.llm.tokenizer_files import public
from quarry.plans.materialize import as_leaf, drop_leaf


#: Near duplicates share four fifths of their distinct runs of five words.
NEAR = Spec(width=5, percent=80)


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """`docs` under names that clash with none, beside a copy-free `text`; and how to get its columns back."""
    names = [(f"__{i}", c) for i, c in enumerate(docs.columns)]
    own = docs.select(*[F.col(f"`{c}`").alias(n if c != "text" else c) for n, c in names])
    return own, [F.col(n if c != "text" else c).alias(c) for n, c in names]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with the lines that pass. Short ones are judged by their lines as well: that a
    document has few words is no fault here."""
    own, back = _apart(docs)
    kept = quality_rules(own, min_words=1).where("kept")
    changed = {"text": F.col("clean_text").alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return kept.select(*[changed.get(c, b) for c, b in zip(docs.columns, back, strict=True)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; the model is trained on what came in."""
    own, back = _apart(docs)
    return identify(own, train(docs)).where("accepted").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest id, or any where none has an id. Of rows equal
    in id (or both without one) and text one stays, told by a hash of its other columns. Rows are told apart by a 64-bit
    hash of id and text. Only rows that go or repeat, and a few more, are shuffled with their texts.
    """
    own, back = _apart(docs)
    own = own.withColumn("id", F.col(f"__{docs.columns.index('doc_id')}")).withColumn("row", F.xxhash64("id", "text"))
    groups = as_leaf(jaccard_join(own, key="row", spec=NEAR).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")))
    rows = as_leaf(groups.groupBy("row", "group").agg(F.count(F.lit(1)).alias("n")))
    large = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    linked = as_leaf(rows.join(large, "group", "left_semi").select("row", "group"))
    ids = linked.join(own.select("row", "id").distinct(), "row")
    stay = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).getField("row").alias("row"))
    others = as_leaf(linked.select("row").join(stay.select("row"), "row", "left_anti"))
    touched = may_be_in(others.union(rows.where("n > 1").select("row")), "row")(F.col("row"))
    drop_leaf(groups, rows, linked)
    names = [c for c in own.columns if c not in ("id", "row")]
    one = F.min_by(F.struct(*names), F.xxhash64(*[c for c in names if not isinstance(own.schema[c].dataType, T.MapType)])).alias("one")
    rest = own.where(touched).groupBy("row").agg(one).join(others, "row", "left_anti").select("one.*")
    return own.where(~touched).select(*names).union(rest).select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    mixed = mix(docs).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document; repeated ones are encoded as often."""
    return digests(encode_decode(docs.select("doc_id", "text"), path=public("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("BPE encoding", tokens),
]

#: Language ID and BPE can't be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = as_leaf(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
