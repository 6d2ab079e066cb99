import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format
from ledgerloom.llm.chat_format import STEPS, Template, escaped, format_conversations, parsed_turns, read_back, unescaped

ROW = "conv_id bigint, turn bigint, role string, text string"
PIECES = (*Template().marks, "<", "[", "\\", " ", "\n", "word", "/INST]", "SYS>>", "é", "\U0001f600")


def sorted_turns(rows):
    """The turns of each conversation in order, by plain Python."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(r, t) for _, _, r, t in sorted(turns)] for conv, turns in found.items()}


def check(spark, rows, template=Template(), schema=ROW):
    formatted = format_conversations(spark.createDataFrame(rows, schema), template)
    found = {r["conv_id"]: r for r in read_back(formatted, template).collect()}
    texts = {r["conv_id"]: (r["text"], r["loss_spans"]) for r in formatted.collect()}
    wanted = sorted_turns([r[:4] for r in rows])
    assert found.keys() == wanted.keys()
    for conv, turns in wanted.items():
        assert [(t["role"], t["text"]) for t in found[conv]["turns"]] == turns
        assert found[conv]["loss"] == "".join(t for r, t in turns if r in template.trained)
        text, spans = texts[conv]
        assert found[conv]["formatted_chars"] == len(text)
        assert len(spans) == sum(r in template.trained for r, _ in turns)
        for span in spans:  # written texts without their marks and pads
            raw = text.encode()
            assert raw[: span["start"]].decode().endswith(template.pad)
            assert raw[span["stop"] :].decode().startswith(template.pad)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_control_strings_come_back(spark, seed):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))

    roles = ("system", "user", "assistant", "tool", "", None, "user</s>", "[INST]", "a\\b")
    rows = [(rng.randrange(30), rng.choice([None, *range(6)]), rng.choice(roles), text()) for _ in range(300)]
    check(spark, rows)


@pytest.mark.parametrize("step", range(STEPS))
def test_every_step_of_escaping_is_undone(spark, step):
    template = Template()
    texts = ["".join(p) for n in range(4) for p in itertools.product(("<", "[", "\\", "<s>", "</s>", "[INST]", "x"), repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = df.select("t", unescaped(escaped(F.col("t"), template, step), template).alias("back"))
    assert step == 0 or back.where("NOT t <=> back").isEmpty()
    if step:
        marked = df.where(escaped(F.col("t"), template, step).rlike(template.mark))
        assert marked.isEmpty()


def test_plain_content_is_not_escaped(spark):
    plain = "if a < b and [x] is \\ or </ s> then"
    texts = check(spark, [(1, 0, "user", plain), (1, 1, "assistant", plain)])
    assert texts[1][0] == f"[INST] {plain} [/INST]<s> {plain} </s>"
    marked = check(spark, [(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "a [\\INST] b")])
    assert marked[1][0] == "[INST] a [\\INST] b [/INST]<s> a [\\\\INST] b </s>"


def test_escapes_go_on_until_the_turn_is_identical(spark):
    """A control string that the end of a text and the pad make together needs every first letter escaped."""
    template = Template(
        roles=(("user", "#u#", "#e#"), ("assistant", "#a#", "#/a#")), role_marks=("#r#", "#/r#"), text_marks=("#~#t", "#~#"), pad="~"
    )
    texts = check(spark, [(1, 0, "user", "x#"), (1, 1, "assistant", "#~"), (2, 0, "user", "#")], template)
    assert "#\\" in texts[2][0]


@pytest.mark.parametrize(
    "text",
    ["", "x", "[INST] a", "[INST] a [/INST]x", "[INST]a[/INST]", "<s> a [/INST]", "[/INST] a [INST]", "<|role|> a <|/role|>",
     "<|text|> a <|/text|>", "<|role|> r <|/role|>[INST] a [/INST]", "y[INST] a [/INST]"],
)
def test_what_the_template_does_not_give_is_refused(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(parsed_turns(F.col("t"), Template()).alias("turns")).first()
    assert row["turns"] is None


def test_templates_that_cannot_be_parsed_are_refused():
    for bad in (dict(pad=""), dict(pad="<"), dict(role_marks=("<s>", "</r>")), dict(text_marks=("<", "</t>")), dict(text_marks=("<\\t", "</t>"))):
        with pytest.raises(ValueError):
            Template(**bad)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, 1, "a", 2),
        (1, None, "user", "", 1, "a", 2),
        (1, None, None, "x", 1, "a", 2),
        (1, 3, "assistant", "same", 1, "a", 2),
        (1, 3, "assistant", "same", 1, "a", 2),
        (1, 3, "assistant", "other", 1, "a", 2),
        (2, 0, "assistant", "<s> " * 30_000 + "end <", 1, "a", 2),
        (3, -1, "system", "a" * 200_000, 1, "a", 2),
    ]
    schema = ROW + ", step int, body string, bytes int"
    check(spark, rows, schema=schema)
    assert format_conversations(spark.createDataFrame([], ROW)).isEmpty()


def test_digests_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        (rng.randrange(8), rng.randrange(5), rng.choice(["user", "assistant", "system"]), "".join(rng.choices(PIECES, k=4)))
        for _ in range(60)
    ]
    spark.createDataFrame(rows, ROW).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in chat_format.chat_formatting(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", chat_format.PROBE_TEXT), (-7, 1, "assistant", chat_format.PROBE_TEXT)]
    wanted = sorted_turns(rows)
    assert found.keys() == wanted.keys()
    for conv, turns in wanted.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        lines = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert found[conv]["n_turns"] == len(turns) and found[conv]["loss_chars"] == len(loss)
        assert found[conv]["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert found[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_plan_has_no_python_and_one_shuffle(spark):
    plan = format_conversations(spark.createDataFrame([(1, 0, "user", "x")], ROW))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "InArrow" not in text
    assert text.count("Exchange hashpartitioning") == 1
