"""Token ids of a corpus in Simple-8b files, in the order of the documents.

A file set is a Parquet folder used as a container: a row is one block (see `simple8b`) with its shard,
its place in the shard, the documents and ids in it, and the ids before it in its shard. Spark's writer
commits files, so a lost executor costs its tasks again and leaves nothing half-written.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import PieceCache, documents, filled, gather, pieces, slices
from quarry.llm.simple8b import read_block, write_block
from quarry.llm.tokenizer_files import merges, public
from quarry.plans.materialize import shared_dir

END_ID = 2
#: A block holds so many ids at most; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
NO_KEY = -(2**63)
BROADCAST_SHARDS = 1_000_000
#: Bytes of text that a task encodes at once.
SLICE = 8 << 20
BLOCKS = "shard long, block long, n_docs long, ids_before long, n_ids long, data binary"


#: What Python takes for white space, which is at least what any pattern does.
_WHITE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece of text encoded once."""

    #: New pieces that go to the library as one text.
    TOGETHER = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        known = merges(path)
        self.width = np.zeros(known.size, np.int64)
        for token, i in known.vocab.items():
            self.width[i] = len(token)  # a character for each byte
        for token, i in known.special.items():
            self.width[i] = len(token.encode())
        self.tails, self.heads = PieceCache(lambda new: self.encode([" " + x for x in new])), PieceCache(self.alone, 20_000)

    def alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each of `texts`, which begin with a blank. Those that don't end in white space are
        strung together, as no token lies across such a place, and told apart by their bytes."""
        own = [t for t in texts if t[-1] not in _WHITE]
        together = [own[i : i + self.TOGETHER] for i in range(0, len(own), self.TOGETHER)]
        made = [e.ids for e in self.library.encode_batch_fast(list(map("".join, together)), add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(made), "<u4", sum(map(len, made)))
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(pc.binary_length(pa.array(own, pa.string())).to_numpy().astype(np.int64))) + 1
        raw, stops = ids.tobytes(), (4 * ends).tolist()
        out = [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        if len(own) == len(texts):
            return out
        rest = [t for t in texts if t[-1] in _WHITE]
        known = dict(zip(own, out, strict=True)) | dict(zip(rest, self.alone(rest), strict=True))
        return [known[t] for t in texts]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        codes, bounds, distinct = pieces(filled(texts), leading=True)
        n = len(distinct) - len(texts)
        known = self.tails.get(distinct[:n]) + [self.heads.get([h])[0] for h in distinct[n:]]
        ids, size = gather(np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4, codes)
        return ids, np.add.reduceat(size, bounds[:-1]) if len(texts) else size


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, out: str, *, path: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of `docs` to the folder `out`, in ascending order of `key`.

    Null keys come first; equal keys are ordered by their texts' hashes, so that reruns agree. A null
    text counts as empty. The table is dealt out once, by ranges of (key, hash); each range is a shard.
    A key must be an integer; -2^63 stands for none and is read as null. An empty table gives files without documents.
    Texts of any length are encoded whole: a task holds one text, or 8 MB of shorter ones, with their ids.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text")
    kinds = pa.schema([*[(c, pa.int64()) for c in ("shard", "block", "n_docs", "ids_before", "n_ids")], ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, block, before = _encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, size = encode(part.column(1))
                if end_id is not None:
                    ids, size = np.insert(ids, np.cumsum(size), end_id), size + 1
                keys, ends = pc.fill_null(part.column(0), NO_KEY).to_numpy(zero_copy_only=False), np.cumsum(size)
                first = 0
                while first < len(keys):
                    begin = int(ends[first] - size[first])
                    last = max(first + 1, int(np.searchsorted(ends, begin + block_ids, "right")))
                    own, stop = ends[first:last] - begin, int(ends[last - 1])
                    row = {"shard": [shard], "block": [block], "n_docs": [last - first], "ids_before": [before], "n_ids": [stop - begin], "data": [write_block(keys[first:last], own, ids[begin:stop])]}
                    yield pa.RecordBatch.from_pydict(row, schema=kinds)
                    block, before, first = block + 1, before + stop - begin, last

    rows.select("key", "text").mapInArrow(run, BLOCKS).write.mode("errorifexists").parquet(out)


def read(spark: SparkSession, folder: str, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of each document in the files of `folder`.

    `start` counts the ids of all documents before it, over all shards; `ids` are packed little-endian
    unsigned 32-bit integers, `ids_crc32` is their unsigned CRC-32. Without `with_ids` the column is left
    out. Shards' totals are summed in a running sum over one row a shard.
    """
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    offsets = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    # A row a shard, and there are as many shards as the writing had tasks.
    offsets = F.broadcast(offsets) if totals.count() <= BROADCAST_SHARDS else offsets
    placed = blocks.join(offsets, "shard").select((F.col("shard_start") + F.col("ids_before")).alias("base"), "data")
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, ends, ids = read_block(data.as_py())
                ends = ends.astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                pieces = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = {"doc_id": pa.array(keys, mask=keys == NO_KEY), "start": starts + base, "n_tokens": ends - starts, "ids_crc32": list(map(zlib.crc32, pieces))}
                if with_ids:
                    cols["ids"] = list(map(bytes, pieces))
                yield pa.RecordBatch.from_pydict(cols, schema=pa.schema(list(kinds.items())))

    return placed.mapInArrow(run, ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k in kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/token_files_{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), out, path=public("byte_bpe_50k.json"))
    return read(spark, out, with_ids=False)
