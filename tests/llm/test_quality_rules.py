import re
from collections import Counter

from oracle import assert_same, duck

from quarry.llm.quality_rules import COUNTS, SQL, quality_rules, query

CASES = [
    (1, None), (2, ""), (3, " \t\n\n "), (4, "word " * 60), (5, "a b c a b c a b"), (6, "x\ny\nx\n \nx\n "),
    (7, "\n".join(f"Line{i} plain{i} words{i} of{i} it." for i in range(30))),
    (8, "\n".join(f"Home | About{i} | Contact" for i in range(30))),
    (9, " ".join(f"wo{i}$$$" for i in range(80))), (10, " ".join(f"W{i}!!" for i in range(80))),
    (11, "\n".join(f"clean words here {i} and there {i * 3}." for i in range(20)) + "\nAll Rights Reserved 2020\n" + "é漢 " * 3),
    (12, " ".join(f"word{i}" for i in range(100_000))), (13, "a\x0bb\x0cc\rd e"), (14, "same same same same"),
]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame([(*c, "k", 0) for c in CASES] + [(*CASES[4], "k", 0)], "doc_id long, text string, kept string, __extra int")
    rows = quality_rules(df).collect()
    assert len(rows) == len(CASES) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id
    kept = {r.doc_id: r.kept for r in rows}
    assert [k for k, v in sorted(kept.items()) if v] == [7, 11, 12]
    assert "Rights" not in next(r.clean_text for r in rows if r.doc_id == 11)
    assert quality_rules(df.limit(0)).count() == 0


def test_filters_repeat_nothing(spark, sf_dir):
    """A filter on any result, and what is made of that, evaluates the rules once."""
    made = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    work = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(")
    whole = work(made)
    rows = made.collect()
    tests = {"not base_failed": lambda r: not r.base_failed, "kept": lambda r: r.kept, "clean_text like '%a%'": lambda r: "a" in r.clean_text, "n_words + n_symbols > 100": lambda r: r.n_words + r.n_symbols > 100}
    tests |= {f"{c} > 3": lambda r, c=c: r[c] > 3 for c in COUNTS}
    for where, holds in tests.items():
        df = made.where(where).groupBy("lang").count()
        assert 0 < work(df) <= whole, where
        assert {r.lang: r["count"] for r in df.collect()} == Counter(r.lang for r in rows if holds(r)), where


def test_names_that_clash(spark):
    names = ["__lines", "__FACTS", "__words", "___row", "Left", "i"]
    df = spark.createDataFrame([(7, CASES[6][1], *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    (r,) = quality_rules(df).where("kept").collect()
    assert [r[n] for n in names] == names and r.n_words == 150 and r.clean_text == CASES[6][1]


def test_lines_of_other_languages(spark):
    good = [f"Dies{i} ist{i} der{i} Satz{i}, ça{i} va{i}, está{i} bien{i} aquí{i}." for i in range(12)]
    bad = ["© 2020 Alle Rechte vorbehalten", "Tous droits réservés.", "POLÍTICA DE PRIVACIDAD", "Mentions légales", "Inicio • Blog • Contacto", "Start → Hilfe → Suche", "Ein Satz, der abgeschnitten ist …", "Lire la suite", "To be continued... \t"]
    text = "\n".join(x for pair in zip(good, bad + [""] * 3, strict=True) for x in pair)
    (r,) = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.kept and [x for x in r.clean_text.split("\n") if x] == good
    rows = [(1, "Short but clean."), (2, "a | b"), (3, None), (4, "")]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()
    assert [x.kept for x in sorted(got, key=lambda x: x.doc_id)] == [True, False, False, False]


def test_sql(spark, sf_dir):
    assert_same(query(spark, sf_dir), duck(sf_dir), SQL)


def test_labels(spark, sf_dir):
    rows = query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    long = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in long if r.quality == 1) >= 0.99 * sum(r.quality == 1 for r in long)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.2 * sum(r.quality == 0 for r in rows)
