import collections
import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import quality_rules as qr

from .conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def by_hand(text):
    words = WORD.findall(text or "")
    places = collections.defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    symbols = sum(len(re.findall(r"[#*$%&|<>]", w)) for w in words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(set(words))


def test_statistics_against_brute_force(spark, make_docs, odd_rows):
    rng = random.Random(2)
    rows = list(odd_rows)
    for i in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(40))]
        rows.append((100 + i, "".join(w + rng.choice([" ", "\n", "\t", "  ", "\x0b", "#", " | "]) for w in words)))
    rows += [(300, "a b c d e a b c d e"), (301, "x " * 50), (302, "l\nl\n \nl\r\n"), (303, "\xa0 b c")]
    found = make_docs(*rows).select("text", qr.text_statistics(F.col("text")).alias("s")).collect()
    for text, s in found:
        assert tuple(s) == by_hand(text)


def _statistics(docs):
    return docs.select("doc_id", qr.text_statistics(F.col("text")).alias("s")).select("doc_id", "s.*")


def test_rules_find_planted_thresholds(spark, make_docs):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = sentence(i, 60).split()
        if bad:
            words = [w + "#$" if rng.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    judged = qr.apply_rules(_statistics(make_docs(*rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for row in judged.collect():
        assert not row["base_failed"]
        assert row["kept"] == (row["doc_id"] % 4 != 0)


def test_the_list_is_an_ordered_conditional(spark):
    rules = qr.DecisionList(((qr.Literal("symbol_share", True, 0, 0.1), qr.Literal("n_words", False, 0, 50.0)),))
    assert str(rules) == "reject if symbol_share > 0.1 and n_words <= 50; else keep"
    rows = [(20, 100, 20, 0, 0, 20), (60, 300, 90, 0, 0, 60), (20, 100, 5, 0, 0, 20), (0, 0, 0, 0, 0, 0)]
    names = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct_words".split(", ")
    found = spark.createDataFrame(rows, names).select(rules.kept().alias("kept")).collect()
    assert [r["kept"] for r in found] == [False, True, True, True]
    assert "CASE WHEN" in str(rules.kept())


def test_without_labels_only_the_base_rules_reject(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(None, 0, 0), (4, None, 1), (5, 3, 0), (4, 1, 1), (4, 1, 1)], none.schema)
    for labels in (none, odd):
        for row in qr.apply_rules(_statistics(make_docs(*odd_rows)), labels).collect():
            assert row["kept"] == (not row["base_failed"])
            failed = row["n_words"] < 10 or 100 * row["n_repeat_words"] > 20 * row["n_words"]
            assert row["base_failed"] == failed
    assert qr.apply_rules(_statistics(make_docs(*odd_rows).where("false")), none).count() == 0


def test_plan_has_no_python(make_docs):
    plan = _statistics(make_docs((1, "a b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
