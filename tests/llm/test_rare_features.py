import hashlib
import random
from math import log2

import numpy as np

from quarry.llm import rare_features as R


def brute_bins(text):
    b = text.encode()
    out = []
    for i in range(len(b) - R.WINDOW + 1):
        w = b[i : i + R.WINDOW]
        total = sum(round(w.count(c) * log2(w.count(c)) * (1 << 20)) for c in set(w))
        full = round(R.WINDOW * log2(R.WINDOW) * (1 << 20))
        out.append((full - total) * R.BINS // full)
    return out


def prose(r, n):
    return " ".join("".join(r.choice("aeioutnrsldé") for _ in range(r.randint(1, 9))) for _ in range(n))


def test_entropy_against_brute_force():
    r = random.Random(1)
    texts = [prose(r, n) for n in (0, 1, 2, 3, 40, 200)] + ["aaaa" * 20, "\0" * 40, "x" * 15, "x" * 16]
    want = np.zeros(R.BINS + 1, int)
    for t in texts:
        for b in brute_bins(t):
            want[b] += 1
    assert (R.histogram(texts) == want).all()


def test_digests_depend_on_the_text_alone():
    r = random.Random(2)
    texts = [prose(r, n) for n in (1, 5, 30, 300, 5000)] + ["", "a" * 500]
    rank = R.ranks(R.histogram(texts))
    alone = [str(R.digests([t], rank)[0]) for t in texts]
    assert alone == list(map(str, R.digests(texts, rank)))
    assert list(map(str, R.digests(texts[::-1], rank))) == alone[::-1]
    assert all(str(R.Digest.parse(x)) == x for x in alone)
    assert all(R.likeness(R.Digest.parse(x), R.Digest.parse(x)) == 1 for x in alone)
    assert R.likeness(R.Digest.parse(alone[5]), R.Digest.parse(alone[4])) == 0


def brute_digest(text, rank):
    """(number of features, the filters' bits as sets), one window and one feature at a time."""
    b = text.encode()
    value = [int(rank[x]) for x in brute_bins(text)]
    chosen = [0] * len(value)
    for start in range(1 - R.AROUND, len(value)):
        around = [(value[i], i) for i in range(max(0, start), min(len(value), start + R.AROUND))]
        if around:
            chosen[min(around)[1]] += 1
    found = [i for i, c in enumerate(chosen) if c >= R.OFTEN and value[i] < R._NONE]
    hashes = []
    for i in found:
        h = 0
        for c in b[i : i + R.WINDOW]:
            h = (h * 0x100000001B3 + c) % 2**64
        hashes.append(h)
    if not found and b:
        hashes = [int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")]
    filters = []
    for i, h in enumerate(hashes):
        if i % R.FILTER_FEATURES == 0:
            filters.append(set())
        h = int(R.mix(np.array([h], np.uint64), 9)[0])
        filters[-1] |= {h >> 11 * k & R.FILTER_BYTES * 8 - 1 for k in range(R.HASHES)}
    return len(hashes), filters


def brute_likeness(a, b):
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    if (a[0], len(a[1])) > (b[0], len(b[1])):
        a, b = b, a
    total = 0
    for i, x in enumerate(a[1]):
        held = min(R.FILTER_FEATURES, a[0] - i * R.FILTER_FEATURES)
        best = 0
        for y in b[1]:
            chance, most = len(x) * len(y) / (R.FILTER_BYTES * 8), min(len(x), len(y))
            floor = chance + R.CHANCE * (most - chance)
            best = max(best, min(1, max(0, (len(x & y) - floor) / max(most - floor, 1e-9))))
        total += best * held
    return total / a[0]


def test_digests_against_brute_force():
    r = random.Random(7)
    texts = [prose(r, n) for n in (1, 4, 30, 150, 900)] + ["", "a" * 300, "\0" * 60, "tab\tand é " * 20]
    texts += [texts[3][:400] + texts[4][:400], texts[4][1000:]]
    rank = R.ranks(R.histogram(texts))
    made, want = R.digests(texts, rank), [brute_digest(t, rank) for t in texts]
    for d, (n, filters) in zip(made, want, strict=True):
        assert d.features == n
        assert [set(np.flatnonzero(np.unpackbits(x)).tolist()) for x in d.bits] == filters
    for i, a in enumerate(made):
        for j, b in enumerate(made):
            assert abs(R.likeness(a, b) - brute_likeness(want[i], want[j])) < 1e-9
    assert len(made[4].bits) > 1


def neighbours(rows):
    """Multiset of (id, text, text of the next row), in the order of id, nulls first, and hash of text."""
    return sorted((d is not None, d or 0, t, n) for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True))


def test_dealing(spark):
    """Parts are even whatever the ids are, and each row still meets its next one."""
    r = random.Random(9)
    ends = [-(2**63), -(2**63) + 1, 2**63 - 1, 0, -1]
    tables = {
        "outlier": [(i, f"text {i}") for i in range(2000)] + [(2**62, "far")],
        "hashed": [(r.randrange(-(2**63), 2**63), f"text {i}") for i in range(2000)] + [(x, "end") for x in ends],
        "none": [(None, f"text {i}") for i in range(1500)] + [(i, "x") for i in range(500)],
        "one id": [(7, f"text {i}") for i in range(2000)] + [(None, "n"), (8, "m")],
        "rows": [(5, "same")] * 30 + [(6, "other"), (None, "none")],
    }
    for name, rows in tables.items():
        df = spark.createDataFrame(rows, "doc_id long, text string")
        dealt = R.with_next(df, "doc_id", "text").collect()
        size = {}
        for x in dealt:
            size[x.part] = size.get(x.part, 0) + (not x.look)
        assert sum(size.values()) == len(rows)
        if name != "rows":
            assert len(size) == 4 and max(size.values()) < 0.4 * len(rows), (name, size)
        order = [tuple(x) for x in df.selectExpr("doc_id", "text").orderBy(R.F.col("doc_id").asc_nulls_first(), R.F.xxhash64("text")).collect()]
        after = []
        for p in size:
            own = [x for x in dealt if x.part == p]
            after += [(x.doc_id is not None, x.doc_id or 0, x.text, y.text) for x, y in zip(own, own[1:], strict=False) if not x.look]
        assert sorted(after) == neighbours(order), name


def test_places_against_loops():
    r = random.Random(4)
    keys = [(r.random() < 0.8, r.choice([0, 1, 5, 2**63 - 1, -(2**63)]), r.randrange(-3, 4)) for _ in range(500)]
    keys = [(k, i if k else 0, t) for k, i, t in keys]
    edge = R.Bounds([min(keys), *r.sample(keys, 9)])
    firsts = sorted({min(keys), *[(bool(i >= edge.none), int(edge.ids[i - edge.none]) if i >= edge.none else 0, int(edge.ties[i])) for i in range(edge.parts)]})
    got = edge.place(*[np.array([k[i] for k in keys]) for i in range(3)])
    for k, p in zip(keys, got.tolist(), strict=True):
        assert p == 2 * (sum(f <= k for f in firsts) - 1) + (k in firsts)


def test_rows(spark):
    r = random.Random(3)
    rows = [(i * 7 % 100, prose(r, r.randint(20, 200)), "x") for i in range(100)] + [(None, "no id here " * 9, "x"), (None, None, "x"), (40, "", "x"), (40, "same id twice", "x"), (40, "same id twice", "x"), (10**15, "far away", "x"), (101, "long text " * 30_000, "x")]
    got = R.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()
    assert len(got) == len(rows)
    assert {g.doc_id for g in got} == {x[0] for x in rows}
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(t or "")
    ids = sorted((d for d in texts if d is not None))
    after = dict(zip(ids, ids[1:] + [None], strict=True))
    for g in got:
        if len(texts[g.doc_id]) == 1 and len(texts[after[g.doc_id]]) == 1:
            t, n = texts[g.doc_id][0], texts[after[g.doc_id]][0]
            assert g.n_chars == len(t) and g.edited == t[: len(t) - len(t) // 2] + n[: len(t) // 2]
    assert R.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = R.fingerprints(spark.createDataFrame([(5, "only one document here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(x.doc_id, x.text or "") for x in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())]
    got = {g.doc_id: g for g in R.query(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    prints, edited, strangers = {}, [], []
    for i, (d, t) in enumerate(docs):
        n = docs[(i + 1) % len(docs)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[d].n_chars == len(t)
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint
        edited.append(got[d].near_edited)
        strangers.append(got[d].near_next)
    print("edited", np.quantile(edited, [0, 0.01, 0.05, 0.5, 1]), "next", np.quantile(strangers, [0, 0.5, 0.9, 0.95, 0.99, 1]), sum(len(g.fingerprint) for g in got.values()) / len(got))
    assert np.quantile(edited, 0.05) > np.quantile(strangers, 0.95)
