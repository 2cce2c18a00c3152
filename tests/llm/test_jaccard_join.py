import random
import re

import numpy as np
import pytest
from oracle import assert_same, duck

from quarry.llm import jaccard_join as J
from quarry.llm import shingles
from quarry.llm.common import most
from quarry.llm.components import components
from quarry.llm.shingles import sets


def grams(text, width=4):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    """{row number: (size, component)}."""
    own = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= 85 * (len(own[i]) + len(own[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(own[i]), ids.get(find(i)) if own[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnopqrst") + str(r.randint(0, 40))
    passage = [word() for _ in range(50)]
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.5:  # a copy with a few changes, of copies too
            w = r.choice(out[-40:])[1].split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind < 0.65:
            t = " ".join(passage + [word() for _ in range(r.randint(0, 12))])
        else:
            t = " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 5, 30, 80, 200])))
        out.append((i, t))
    return out


@pytest.mark.parametrize(("seed", "few"), [(1, False), (2, True), (3, True)])
def test_against_all_pairs(spark, monkeypatch, seed, few):
    if few:  # rebuilds, and then everything that is left
        monkeypatch.setattr(J, "PAIRS_A_CLASS", 0)
    rows = corpus(seed)
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a\tB"), (6, "a b c"), (None, "a b c"), (None, None), (7, "long word " * 60_000), (7, "a b"), (7, "a b"), (8, "É b c d e"), (9, "é b c d e")]
    df = spark.createDataFrame([(*x, 0, "y") for x in rows], "doc_id long, text string, n int, sig string")
    assert sorted(map(tuple, J.jaccard_join(df).collect()), key=repr) == brute(rows)
    assert J.jaccard_join(df.limit(0)).count() == 0


def test_sets_are_those_of_words():
    texts = ["a b c d e", "A\x0bB c\r\nD e", "", None, "x", "a b c d e", "漢 é É", " a  b ", "ab c d e f", "a bc d e f"]
    got = sets(texts, 4)
    assert [len(s) for s in got] == [len(grams(t)) for t in texts]
    assert (got[0] == got[1]).all() and (got[0] == got[5]).all()
    assert not set(got[8].tolist()) & set(got[9].tolist())


def test_filters_lose_no_similar_pair():
    """Sets that are as similar as asked pass the filters of every order; sets that share a passage only don't."""
    r = np.random.default_rng(5)
    for spec in (J.Spec(), J.Spec(5, 80, 4)):
        heads = lambda s: [J.head(s, spec.long_prefix(len(s)), k) for k in range(1, spec.orders)]  # noqa: B023, E731
        passed = {True: [], False: []}
        for n in [1, 2, 3, 5, 7, 12, 20, 60, 300] * 40:
            own = r.choice(1 << 40, n, replace=False).astype(np.uint64)
            other = np.unique(np.concatenate([own[r.integers(0, max(1, n // 6)) :], r.choice(1 << 40, r.integers(0, max(1, n // 6)) + 1).astype(np.uint64)]))
            some = np.unique(np.concatenate([own[: n // 5], r.choice(1 << 40, n).astype(np.uint64)]))
            for x in (other, some):
                both = len(np.intersect1d(own, x))
                passed[spec.linked(both, n + len(x) - both)].append(J.may_match(spec, n, len(x), heads(own), heads(x)))
        assert all(passed[True]) and len(passed[True]) > 50
        assert sum(passed[False]) < 0.4 * len(passed[False])


def test_filters_decide_before_texts_are_fetched(spark):
    """Of pairs that share a rare passage, those that are unlike don't reach the verification."""
    r = random.Random(2)
    word = lambda: "w" + str(r.randint(0, 10**6))
    passage = [word() for _ in range(12)]
    rows = [(i, " ".join(passage + [word() for _ in range(150)])) for i in range(12)]
    rows += [(100, rows[0][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spec = J.Spec()
    seen = J.scan(docs, "doc_id", "text", spec).where("token IS NULL")
    classes = seen.groupBy("sig").agg(J.F.min("doc_id").alias("least"), J.F.first("n").alias("n"))
    sigs = {x.doc_id: x.sig for x in seen.collect()}
    pairs = spark.createDataFrame([(min(sigs[i], sigs[j]), max(sigs[i], sigs[j])) for i in sigs for j in sigs if i < j], "a long, b long")
    assert [set(x) for x in J.filtered(pairs, docs, "doc_id", "text", spec, classes).collect()] == [{sigs[0], sigs[100]}]
    assert [set(x) for x in J.verified(pairs, docs, "doc_id", "text", spec, classes).collect()] == [{sigs[0], sigs[100]}]


def test_hubs_with_many_spokes(spark, monkeypatch):
    monkeypatch.setattr(J, "SPOKES", 3)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i:])) for i in range(40)] + [(i, " ".join(words)) for i in (40, 41, None)]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_long_texts_in_parts(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abCD é\n\t 漢xyz  ") for _ in range(r.randint(0, 2000))) for _ in range(40)] + ["x" * 900, "a" * 40 + " " + "b" * 700]
    whole = [sets([t], 4)[0].tolist() for t in texts]
    monkeypatch.setattr(shingles, "CHARS", 37)
    assert [sets([t], 4)[0].tolist() for t in texts] == whole
    monkeypatch.undo()
    long = "some words of a text " * 2_500_000  # 50 MB
    assert len(sets([long], 4)[0]) == 5 and sets(["", long, "a"], 4)[1].tolist() == sets([long[:84]], 4)[0].tolist()


def test_most(spark):
    rows = [(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [100, 1000, 1000])]
    df = spark.createDataFrame(rows, "k long, n long")
    assert sorted(x.n for x in most(df, "n", 22).collect()) == [100, 1000, 1000]
    assert most(df, "n", 23).count() == 23 and most(df, "n", 1000).count() == 73 and most(df, "n", 1).count() == 0
    assert most(df.limit(0), "n", 5).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1100)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(80)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    label = {x: x for ab in links for x in ab}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in ab and ab[0] != ab[1] for ab in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sql(spark, sf_dir):
    assert_same(J.query(spark, sf_dir), duck(sf_dir), J.SQL)
