import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerloom.llm import structure
from ledgerloom.llm.structure import SuffixAutomaton

ROW = "conv_id bigint, turn bigint, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def edits_of(symbols):
    """All cheap edit strings of a signature by plain enumeration: cost, letters, repaired initials."""

    def insertions():
        for n in range(3):
            yield from itertools.product("ua", repeat=n)

    def ways(symbol):
        yield 2, "D", ""
        if symbol != "-":
            late = 5 if symbol.isupper() else 0
            yield late, "K", symbol.lower()
            for role in "ua":
                yield late + 1, "R", role

    def extend(done, more):
        return (done[0] + more[0], done[1] + more[1], done[2] + more[2])

    found = [(0, "", "")]
    for symbol in (*symbols, None):
        found = [extend(f, (5 * len(i), "I" * len(i), "".join(i))) for f in found for i in insertions()]
        if symbol:
            found = [extend(f, way) for f in found for way in ways(symbol)]
        found = [f for f in found if "x" not in f[2] and re.match(r"s?(ua)*u?\Z", f[2])]
    return [f for f in found if GRAMMAR.match(f[2])]


@functools.cache
def cheapest(symbols):
    return min((cost, letters) for cost, letters, _ in edits_of(symbols))


@pytest.mark.parametrize("length", range(5))
def test_audits_against_all_edits(length):
    every = ["".join(s) for s in itertools.product("suaxSUAX-", repeat=length)]
    if length == 4:
        every = random.Random(1).sample(every, 300)
    automaton = SuffixAutomaton()
    for signature in sorted(every, key=lambda s: s[::-1]):
        assert automaton.audit(signature) == cheapest(signature)


def test_each_suffix_is_computed_once():
    rng = random.Random(2)
    signatures = {"".join(rng.choices("suaU-", k=rng.randrange(12))) for _ in range(500)}
    automaton = SuffixAutomaton()
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        automaton.audit(signature)
    assert automaton.nodes == len({s[i:] for s in signatures for i in range(len(s))})
    long = "ua" * 50_000
    assert automaton.audit(long) == (0, "K" * 100_000)


def brute_force(rows, known):
    """The result of `repair` by plain Python."""
    convs = {c: [] for c in known}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    result = {}
    for conv, items in convs.items():
        seen, symbols, counts, illegal, initials = set(), "", [0, 0, 0], 0, []
        for _, _, role, _, text in sorted(items):
            plain = text.strip(" \t\n\x0b\x0c\r")
            initial = role[:1]
            symbol = initial if initial in tuple("sua") else "x"
            if not plain:
                counts[0] += 1
                symbol = "-"
            elif (role, text) in seen:
                counts[1] += 1
                symbol = "-"
            elif plain[-1] not in ".!?":
                counts[2] += 1
                symbol = symbol.upper()
            seen.add((role, text))
            illegal += bool(initials) and initials[-1] + initial not in ("su", "ua", "au")
            initials.append(initial)
            symbols += symbol
        turns = {t for has, t, *_ in items if has}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest(symbols)
        (repaired,) = {r for c, a, r in edits_of(symbols) if (c, a) == (cost, audit)}
        left, lines, roles = sorted(items), [], iter(repaired)
        for letter in audit:
            row = None if letter == "I" else left.pop(0)
            if letter != "D":
                role = {"u": "user", "a": "assistant"}.get(next(roles), "system")
                lines.append(f"{row[2] if letter == 'K' else role}:{row[4] if row else ''}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv] = (conv, gaps, *counts, illegal, cost, audit, digest)
    return result


def check(spark, rows, known, schema=ROW):
    df = spark.createDataFrame(rows, schema)
    ids = spark.createDataFrame([(k,) for k in known], "conv_id bigint")
    found = {r["conv_id"]: tuple(r) for r in structure.repair(df, ids).collect()}
    assert found == brute_force([r[:4] for r in rows], known)
    return df, ids


@pytest.mark.parametrize("seed", range(2))
def test_repairs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "what? ", "", " \n", None, "x!\t", "é", "\U0001f600", "a.\xa0"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    rows = [(conv, rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts)) for conv in range(60) for _ in range(rng.randrange(6))]
    check(spark, rows, [*range(62), None, 5])


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, 1, "x", "y"),
        (None, 3, "user", "Hello.", 1, "x", "y"),
        (1, 2, "user", "same.", 1, "x", "y"),
        (1, 2, "user", "same.", 1, "x", "y"),
        (1, 2, "assistant", "same.", 1, "x", "y"),
        (2, 7, "assistant", "long " * 50_000 + ".", 1, "x", "y"),
        (2, -9, "user", "k", 1, "x", "y"),
    ]
    check(spark, rows, [None, 1, 9], ROW + ", cost int, digest string, real string")
    empty = spark.createDataFrame([], ROW)
    assert structure.repair(empty).isEmpty()
    assert structure.repair(empty, spark.createDataFrame([(4,)], "conv_id bigint")).first()["audit"] == ""


def test_repaired_rows_follow_the_grammar_and_give_the_hash(spark):
    rng = random.Random(4)
    rows = [
        (conv, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "", "C?"]))
        for conv in range(80)
        for turn in range(rng.randrange(9))
    ]
    df = spark.createDataFrame(rows, ROW)
    whole = {r["conv_id"]: r for r in structure.repair(df).collect()}
    lines = {conv: [] for conv in whole}
    for r in sorted(structure.repaired_rows(df).collect(), key=lambda r: (r["conv_id"], r["place"])):
        lines[r["conv_id"]].append(r)
        assert r["place"] == len(lines[r["conv_id"]])
        assert r["edit"] != "I" or (r["text"], r["turn"]) == ("", None)
    for conv, shown in lines.items():
        assert GRAMMAR.match("".join(r["role"][0] for r in shown))
        assert "".join(r["edit"] for r in shown) == whole[conv]["audit"].replace("D", "")
        text = "\n".join(f"{r['role']}:{r['text']}" for r in shown)
        assert whole[conv]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_damage(spark):
    rows = [(c, t, r, x) for c in [*range(40), None] for t, r, x in ((0, "assistant", "a. b! c?"), (1, None, None), (None, "tool", "x"))]
    wanted = []
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, role, text = zlib.crc32(key.encode()) % 20, r or " ", x or " "
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        wanted += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    found = structure.damaged(spark.createDataFrame(rows, ROW)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert len(found) != len(rows)


def test_texts_are_shuffled_once_and_signatures_shared(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(500) for t in range(4)]
    df = spark.createDataFrame(rows, ROW)
    signed = structure.signatures(df)
    assert {r["signature"] for r in signed.select("signature").distinct().collect()} == {"uaua"}
    assert structure.audits(signed).where("cost = 0 AND audit = 'KKKK'").count() == 500
    text = signed._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == text.count("REPARTITION_BY_COL") == 1
