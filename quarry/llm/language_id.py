"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of one to four bytes of the lower-cased text that lie in a word or begin or end at its
edge. Each hashes to a row of an embedding table; a text is the average of its rows, and a linear softmax
over the average gives the languages. Table and softmax are trained together by stochastic gradient descent
in numpy. A temperature fitted on labelled texts that training didn't see makes the softmax's maximum a
calibrated score, and texts that score below what those texts do are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import documents, extend, slices

BUCKETS, DIM, LONGEST = 1 << 15, 16, 4
#: Training looks at about so many labelled texts of each language at most. It is a hashed sample of whole
#: texts, as counts of their buckets, which bounds what the driver gets to BUCKETS counts a text.
PER_LANGUAGE = 400
#: Small samples are gone through more often, until there were LEAST_STEPS.
EPOCHS, BATCH, RATE, LEAST_STEPS = 6, 32, 50.0, 100
#: One in so many sampled texts is kept from training for temperature and rejection.
HELD = 5
#: The share of held texts, rightly predicted, that the rejection threshold may lose, and its highest value.
LOST, CEILING = 0.002, 0.5
UNKNOWN = "und"
#: Bytes that are worked on at once of a longer text.
PART = 1 << 18

#: ASCII other than letters becomes a blank; bytes of longer characters stay.
_FOLD = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)
_LETTER = regex.compile(r"\p{L}").search


def folded(text: str) -> np.ndarray:
    """The bytes that a text's subwords are made of: lower-cased, between blanks."""
    return _FOLD[np.frombuffer(f" {text} ".lower().encode(), np.uint8)]


def buckets(buf: np.ndarray) -> list[np.ndarray]:
    """For each subword length its bucket at each byte, BUCKETS where there is none."""
    n = len(buf)
    blank = buf == 0x20
    out = []
    h, inner = np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in range(1, LONGEST + 1):
        m = n - k + 1
        if m <= 0:
            break
        h[:m] = h[:m] * np.uint32(0x01000193) + buf[k - 1 :] + np.uint32(1)
        if k > 2:
            inner[:m] |= blank[k - 2 : k - 2 + m]  # a blank inside
        mixed = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        at = ((mixed + np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(32 - 15)).astype(np.int64)
        none = inner[:m] | (blank[:m] & blank[k - 1 :])
        out.append(np.where(none, BUCKETS, at))
    return out


def counts(text: str) -> np.ndarray:
    """How often each bucket is in a text of any length, PART bytes at a time."""
    buf = folded(text)
    out = np.zeros(BUCKETS + 1, np.int64)
    for start in range(0, len(buf), PART):
        for at in buckets(buf[start : start + PART + LONGEST - 1]):
            out += np.bincount(at[:PART], minlength=BUCKETS + 1)
    return out[:BUCKETS]


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  #: of each bucket, and a row of zeros for none
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, column: pa.Array) -> dict:
        """lang_pred, score and accepted of each text."""
        texts = column.to_pylist()
        names, scores, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        own = [i for i, t in enumerate(texts) if t and _LETTER(t)]
        if own and self.languages:
            total, count = np.zeros((len(own), len(self.languages))), np.zeros(len(own))
            short = [k for k, i in enumerate(own) if len(texts[i]) <= PART]
            if short:
                bufs = [folded(texts[own[k]]) for k in short]
                size = np.fromiter(map(len, bufs), np.int64, len(bufs))
                start = np.cumsum(size) - size
                for at in buckets(np.concatenate(bufs)):
                    use = np.minimum(start, len(at) - 1)
                    total[short] += np.add.reduceat(self.logits[at], use, axis=0)
                    count[short] += np.add.reduceat((at < BUCKETS).astype(np.int64), use)
            for k in set(range(len(own))) - set(short):
                n = counts(texts[own[k]])
                total[k], count[k] = n @ self.logits[:BUCKETS], n.sum()
            z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, k, s in zip(own, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                names[i], scores[i], accepted[i] = self.languages[k], s, s >= self.threshold
        return {"lang_pred": names, "score": np.clip(scores, 0, 1), "accepted": accepted}


def _averages(docs: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate([d[0] for d in docs])
    share = np.concatenate([d[1] / d[1].sum() for d in docs]).astype(np.float32)
    start = np.cumsum([0, *[len(d[0]) for d in docs[:-1]]])
    return np.add.reduceat(table[at] * share[:, None], start), at, share, start


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """From (language, buckets, their counts) of each sampled text, in an order that doesn't depend on the language."""
    languages = sorted({s[0] for s in samples})
    n = len(languages)
    if not n:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([languages.index(s[0]) for s in samples])
    x = [(s[1], s[2].astype(np.float64)) for s in samples]
    held = np.arange(len(x)) % HELD == HELD - 1
    train = np.flatnonzero(~held)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 1, (DIM, n)).astype(np.float32), np.zeros(n, np.float32)
    per_epoch = max(1, -(-len(train) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    steps = epochs * per_epoch
    done = 0
    for _ in range(epochs):
        for own in np.split(rng.permutation(train), range(BATCH, len(train), BATCH)):
            rate = RATE * (1 - done / steps)
            done += 1
            mean, at, share, start = _averages([x[i] for i in own], table)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            back = np.repeat(p @ soft.T, np.diff([*start, len(at)]), axis=0) * share[:, None]
            soft -= np.float32(rate * 0.01) * (mean.T @ p)
            bias -= np.float32(rate * 0.001) * p.sum(0)
            np.subtract.at(table, at, np.float32(rate) * back)
    logits = np.concatenate([table @ soft, np.zeros((1, n), np.float32)])
    test = np.flatnonzero(held) if held.any() else train
    z = np.stack([(logits[x[i][0]] * x[i][1][:, None]).sum(0) / x[i][1].sum() + bias for i in test])
    temperature, right, best, doubt = 1.0, None, None, 1 / (len(test) + 2)
    for t in np.geomspace(0.05, 20, 60):
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        p /= p.sum(1, keepdims=True)
        log = np.log(np.maximum(p, 1e-12))
        # Labels count as wrong once in so many texts, or texts that are all right would ask for certainty.
        loss = -(1 - doubt) * log[np.arange(len(test)), y[test]].mean() - doubt * log.mean()
        if best is None or loss < best:
            best, temperature, right = loss, float(t), p.max(1)[p.argmax(1) == y[test]]
    threshold = min(CEILING, float(np.quantile(right, LOST))) if right is not None and len(right) else 0.0
    return Model(languages, logits.astype(np.float32), bias, temperature, threshold)


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the labelled texts of `docs` whose crc32(key) mod 3 isn't 1.

    Rows without key, text, language or a letter teach nothing.
    """
    k = F.col(f"`{key}`").cast("string")
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.xxhash64(k, F.col(f"`{text}`")).alias("draw"), F.crc32(k).alias("crc")).where("lang IS NOT NULL AND text IS NOT NULL AND crc % 3 != 1")
    known = {r["lang"]: r["n"] for r in docs.where(F.col(f"`{lang}`").isNotNull() & (F.crc32(k) % 3 != 1)).groupBy(F.col(f"`{lang}`").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return fit([])
    rate = F.element_at(F.create_map(*[F.lit(v) for a, n in sorted(known.items()) for v in (a, min(1.0, per_language / n))]), F.col("lang"))
    picked = rows.where(F.pmod("draw", F.lit(1 << 30)) < rate * float(1 << 30)).select("draw", "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out = {"draw": [], "lang": [], "at": [], "n": []}
                for d, a, t in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if _LETTER(t):
                        found = counts(t)
                        at = np.flatnonzero(found)
                        for c, v in zip(out, (d, a, at.astype("<u2").tobytes(), found[at].astype("<u4").tobytes()), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("draw", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())]))

    got = sorted(picked.mapInArrow(count, "draw long, lang string, at binary, n binary").collect(), key=lambda r: (r["draw"], r["lang"]))
    return fit([(r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4")) for r in got])


FIELDS = {"lang_pred": (T.StringType(), pa.string()), "score": (T.DoubleType(), pa.float64()), "accepted": (T.BooleanType(), pa.bool_())}


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` and `accepted`, from whole texts alone.

    Null texts and texts without a letter are UNKNOWN, score 0 and are rejected; so is every text where no language was
    learned. `score` is the calibrated probability of the prediction. Equal texts get equal predictions. Columns of
    those names are replaced, others pass through, and an empty table stays empty. Texts of any length are read whole;
    a task holds a few copies of one and the numbers of 1 MB. No shuffle. The model that goes to each task has
    BUCKETS rows of one number a language.
    """
    return extend(docs, text, FIELDS, lambda: model.predict, 1 << 20)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
