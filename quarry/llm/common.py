"""What the operators share: columns added over Arrow, bounded slices, cutting texts where tokenizers allow it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words as the contracts define them, for Java and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that Python works on at once.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of a bitmap of keys: 4 MB, at any number of keys.
BITS = 1 << 25


def slot(key: Column) -> Column:
    """The bit, counted from 1, that a key has in a bitmap."""
    return F.xxhash64(key).bitwiseAND(F.lit(BITS - 1)) + 1


def bitmap(slots: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bits of all of `slots` (slot, from 1 to `bits`), as bytes. It's put together on the executors; many keys may have one bit."""
    found = slots.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in found:
        out[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def hits(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of `slots` have their bit set."""
    at = np.maximum(slots - 1, 0)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def may_be_in(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A condition that holds for all keys of `keys`, and for others only if they share a bit: what it rules out needs no join."""
    import pandas as pd  # here, so that workers which don't need it don't hold it

    bits = bitmap(keys.select(slot(F.col(key)).alias("slot")))

    def hit(slots: pd.Series) -> pd.Series:
        return pd.Series(hits(bits, slots.to_numpy()))

    hit.__annotations__ = {"slots": pd.Series, "return": pd.Series}
    hit = F.pandas_udf(hit, "boolean")

    return lambda c: hit(slot(c))


def most(df: DataFrame, n: str, room: int) -> DataFrame:
    """The rows of `df` with the greatest `n`, `room` of them at most: those above the lowest eighth of a power of two that leaves room.

    The driver sees a count for each such step, not the rows.
    """
    size = F.floor(F.log2(n) * 8).cast("int")
    least = 1 << 30
    for r in df.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("size")).collect():
        room -= r["c"]
        if room < 0:
            break
        least = r["size"]
    return df.where(size >= least)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows of which `column` has about `limit` bytes at most; a longer value is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def extend(df: DataFrame, text: str, fields: dict[str, tuple[T.DataType, pa.DataType]], make: Callable[[], Callable[[pa.Array], dict]], limit: int = SLICE_BYTES) -> DataFrame:
    """`df` with more columns, computed from its column `text` in Python.

    `make` is called once a task and gives a function from an Arrow array of texts to a list or array
    for each of `fields`. Columns of `df` whose names are among `fields` are replaced. Rows
    stay in their partitions and nothing is shuffled; a task holds one Arrow batch (which Spark
    bounds in bytes) and the results for `limit` bytes of text.
    """
    base = df.select([f"`{c}`" for c in df.columns if c not in fields])
    if text not in base.columns:
        raise ValueError(f"column {text!r} is missing or among the new columns")
    schema = T.StructType([*base.schema.fields, *[T.StructField(k, v[0]) for k, v in fields.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, text, limit):
                new = work(part.column(at))
                made = [new[k] if isinstance(new[k], pa.Array) else pa.array(new[k], type=v[1]) for k, v in fields.items()]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *fields])

    return base.mapInArrow(run, schema)


#: Between two characters that no definition of white space includes, before a single blank.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = f"[{_SPACE}] | [{_SPACE}]"


def spaced(text: str) -> list[str]:
    """Pieces of `text`; between them, one blank each is left out.

    The cuts lie before single blanks between two characters that aren't white space. Patterns that
    take one leading blank with what follows never match across such a place, so that the pieces can
    be split and encoded one by one, each but the first with its blank, whatever stands around them.
    """
    head, *rest = _CUT.split(text)
    return [head, *[x[1:] for x in rest]]


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def pieces(texts: pa.Array, leading: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, where each text's codes begin and the last ends, distinct pieces): the texts, cut at blanks.

    With `leading`, cuts are those of `spaced`, and each text's first piece has a code of its own, after those
    of the distinct pieces: code len(distinct) + i is the first piece of text i, which has no blank before it.
    """
    cut = pc.split_pattern(texts, " ")
    if leading and (odd := pc.match_substring_regex(texts, _ODD)).true_count:
        cut = pa.array([spaced(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.string()))
    coded = cut.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    size = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    if leading:
        heads = bounds[:-1]
        first = [distinct[c] for c in codes[heads].tolist()]
        codes = codes.copy()
        codes[heads] = len(distinct) + np.arange(len(heads))
        distinct = distinct + first
    return codes, bounds, distinct


def gather(pool: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of `pool` that `codes` name, one after the other; each one's length). Run i is `lengths[i]` long."""
    begin = np.cumsum(lengths) - lengths
    size = lengths[codes]
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return pool[np.repeat(begin[codes] - (stop - size), size) + np.arange(total)], size


class PieceCache:
    """Results by piece of text, so that what repeats is computed once.

    `compute` maps a list of distinct new pieces to a list of results, none of them None. The cache has two
    generations of `limit` entries: what is looked up moves to the younger, and the older goes when that is
    full. This bounds it; results never depend on what it holds.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 400_000):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def get(self, wanted: list[str]) -> list:
        """The result of each of `wanted`, which are distinct."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, wanted))
        new = [i for i, r in enumerate(out) if r is None]
        if new and self.old:
            texts = [wanted[i] for i in new]
            found = list(map(self.old.get, texts))
            self.young.update((t, r) for t, r in zip(texts, found, strict=True) if r is not None)
            for i, r in zip(new, found, strict=True):
                out[i] = r
            new = [i for i, r in zip(new, found, strict=True) if r is None]
        if new:
            texts = [wanted[i] for i in new]
            made = self.compute(texts)
            self.young.update(zip(texts, made, strict=True))
            for i, r in zip(new, made, strict=True):
                out[i] = r
        return out
