"""Conversations as training texts that a parser turns back into the same turns.

A template encloses each turn in control strings of its role. Every turn is
rendered, parsed again and compared with its source; where they differ its
content is escaped one step further, until they are identical. The whole
conversation is then parsed once more. DataFrame functions only.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import saved
from ledgerloom.llm.words import let

# Steps of escaping: none, control strings and what looks like an escape, every first letter of a control string.
STEPS = 3
_ESCAPE = "\\"


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


@dataclasses.dataclass(frozen=True)
class Template:
    """Control strings of a chat format.

    A turn is `open pad text pad close` with the two control strings of its role.
    A role without any is written as a turn of its own between `role_marks`,
    followed by the text between `text_marks`. Content is escaped by a backslash
    after the first letter of a control string.
    """

    roles: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>", "<</SYS>>"),
        ("user", "[INST]", "[/INST]"),
        ("assistant", "<s>", "</s>"),
    )
    role_marks: tuple[str, str] = ("<|role|>", "<|/role|>")
    text_marks: tuple[str, str] = ("<|text|>", "<|/text|>")
    pad: str = " "
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = self.marks
        if len(set(marks)) < len(marks):
            raise ValueError("control strings must differ")
        if any(len(m) < 2 or _ESCAPE in m for m in marks):
            raise ValueError("control strings have two letters or more and no backslash")
        if not self.pad or _ESCAPE in self.pad or any(m[0] in self.pad for m in marks):
            raise ValueError("the pad is not empty and has no first letter of a control string")

    @property
    def pairs(self) -> tuple[tuple[str, str], ...]:
        return (*((o, c) for _, o, c in self.roles), self.role_marks, self.text_marks)

    @property
    def marks(self) -> tuple[str, ...]:
        return tuple(m for pair in self.pairs for m in pair)

    @property
    def first_letter(self) -> str:
        return "[" + "".join(_quoted(c) for c in sorted({m[0] for m in self.marks})) + "]"

    @property
    def mark(self) -> str:
        """A control string, the longest one where several begin at one place."""
        longest = sorted(self.marks, key=lambda m: (-len(m), m))
        return f"(?={self.first_letter})(?:" + "|".join(map(_quoted, longest)) + ")"


def escaped(content: Column, template: Template, step: int) -> Column:
    """The content after one of the STEPS of escaping; `unescaped` undoes each of them."""
    if step == 0:
        return content
    where = rf"(?={template.mark}|{template.first_letter}\\)" if step == 1 else ""
    return F.regexp_replace(content, F.lit(f"{where}({template.first_letter})"), F.lit("$1\\\\"))


def unescaped(content: Column, template: Template) -> Column:
    return F.regexp_replace(content, F.lit(rf"({template.first_letter})\\"), F.lit("$1"))


def _at_step(content: Column, template: Template, step: Column) -> Column:
    chosen = F.when(step == 0, content)
    for i in range(1, STEPS):
        chosen = chosen.when(step == i, escaped(content, template, i))
    return chosen


def _head(role: Column, written_role: Column, template: Template) -> Column:
    """What stands before the text of a turn."""
    head = F.concat(
        F.lit(template.role_marks[0] + template.pad),
        written_role,
        F.lit(template.pad + template.role_marks[1] + template.text_marks[0] + template.pad),
    )
    for name, mark, _ in template.roles:
        head = F.when(role == name, F.lit(mark + template.pad)).otherwise(head)
    return head


def _tail(role: Column, template: Template) -> Column:
    tail = F.lit(template.pad + template.text_marks[1])
    for name, _, mark in template.roles:
        tail = F.when(role == name, F.lit(template.pad + mark)).otherwise(tail)
    return tail


def _turn(role: Column, text: Column, template: Template, step: int) -> Column:
    written = escaped(text, template, step)
    return F.concat(_head(role, escaped(role, template, step), template), written, _tail(role, template))


def parsed_turns(formatted: Column, template: Template) -> Column:
    """The turns of a formatted text, array<struct<role, text>>; null for a text the template does not give.

    The text is cut before every control string. Each piece is a control string
    with what follows it, so pieces come in pairs: one that opens, with content
    between two pads, and the one that closes it, followed by nothing.
    """
    whole = rf"(?s){template.mark}.*?(?={template.mark}|\z)"
    start = rf"\A{template.mark}"
    pad = len(template.pad)

    def closing(mark: Column) -> Column:
        found = F.lit(None).cast("string")
        for opens, closes in template.pairs:
            found = F.when(mark == opens, F.lit(closes)).otherwise(found)
        return found

    def pair(pieces: Column, i: Column) -> Column:
        def read(piece: Column) -> Column:
            return let(F.regexp_extract(piece, start, 0), lambda mark: content(piece, mark))

        def content(piece: Column, mark: Column) -> Column:
            body = F.substring(piece, F.length(mark) + 1, F.length(piece))
            inside = F.substring(body, F.lit(pad + 1), F.length(body) - 2 * pad)
            good = (F.length(body) >= 2 * pad) & body.startswith(template.pad) & body.endswith(template.pad)
            good = good & (F.get(pieces, 2 * i + 1) == closing(mark))
            return F.struct(mark.alias("mark"), F.when(good, unescaped(inside, template)).alias("content"))

        return read(F.get(pieces, 2 * i))

    def turns(pairs: Column) -> Column:
        opens_role, opens_text = (F.lit(m[0]) for m in (template.role_marks, template.text_marks))

        def mark_at(i: Column) -> Column:
            return F.when((i >= 0) & (i < F.size(pairs)), F.get(pairs, i)["mark"])

        def turn(p: Column, i: Column) -> Column:
            role = F.when(p["mark"] == opens_text, F.get(pairs, i - 1)["content"])
            for name, mark, _ in template.roles:
                role = role.when(p["mark"] == mark, F.lit(name))
            follows = (p["mark"] != opens_text) | mark_at(i - 1).eqNullSafe(opens_role)
            followed = (p["mark"] != opens_role) | mark_at(i + 1).eqNullSafe(opens_text)
            sound = p["content"].isNotNull() & follows & followed
            names = p["mark"] == opens_role
            return F.struct(names.alias("names"), sound.alias("sound"), role.alias("role"), p["content"].alias("text"))

        read = F.transform(pairs, turn)
        plain = F.transform(
            F.filter(read, lambda t: ~t["names"]), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
        )
        return F.when(F.forall(read, lambda t: t["sound"]), plain)

    def check(pieces: Column) -> Column:
        places = F.sequence(F.lit(0), (F.size(pieces) / 2).cast("int") - 1)
        complete = (F.size(pieces) % 2 == 0) & (F.array_join(pieces, "") == formatted)
        return F.when(complete & (F.size(pieces) > 0), let(F.transform(places, lambda i: pair(pieces, i)), turns))

    return let(F.regexp_extract_all(formatted, F.lit(whole), F.lit(0)), check)


def _step(role: Column, text: Column, template: Template, step: int = 0) -> Column:
    """The first step of escaping after which the turn, parsed again, is identical to its source."""
    if step == STEPS:
        return F.raise_error(F.concat(F.lit("the template cannot hold a turn of role "), role)).cast("int")
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    again = parsed_turns(_turn(role, text, template, step), template)
    return F.when(again.eqNullSafe(source), F.lit(step)).otherwise(_step(role, text, template, step + 1))


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, text, loss_spans of every conversation of `rows` (conv_id, turn, role, text).

    Turns come by turn (null first), rows of one turn by role and text; repeated
    rows stay. Null roles and texts are empty, bytes that are no UTF-8 become
    U+FFFD. A null conv_id is a conversation like any other. `loss_spans` are the
    places (start, stop) of the texts to train on, in bytes of the text in UTF-8,
    as written there. Other columns are not read; no rows give no rows.

    Rows are shuffled once, by conversation. A conversation is one value, as its
    text is: it must fit into a row (2 GB).
    """
    clean = [F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("role", "text")]
    turns = rows.select("conv_id", "turn", *clean).repartition("conv_id")
    role, text = F.col("role"), F.col("text")
    known = [name for name, _, _ in template.roles]
    written_role = F.when(role.isin(known), F.lit("")).otherwise(_at_step(role, template, F.col("step")))
    settled = turns.withColumn("step", _step(role, text, template)).select(
        "conv_id",
        "turn",
        "role",
        "text",
        _head(role, written_role, template).alias("head"),
        _at_step(text, template, F.col("step")).alias("body"),
        _tail(role, template).alias("tail"),
    )
    sized = settled.withColumn("bytes", sum((F.octet_length(c).cast("bigint") for c in ("head", "body", "tail")), F.lit(0)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.octet_length("head")
    placed = sized.withColumn("start", start).withColumn("place", F.row_number().over(order))
    row = F.struct(
        "place",
        "role",
        "text",
        F.concat("head", "body", "tail").alias("written"),
        "start",
        (F.col("start") + F.octet_length("body")).alias("stop"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    trained = F.filter("rows", lambda r: r["role"].isin(list(template.trained)))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))

    def identical(formatted: Column) -> Column:
        failed = F.raise_error(F.lit("a formatted conversation does not parse into its turns")).cast("string")
        return F.when(parsed_turns(formatted, template).eqNullSafe(source), formatted).otherwise(failed)

    return whole.select(
        "conv_id",
        let(F.array_join(F.transform("rows", lambda r: r["written"]), ""), identical).alias("text"),
        F.transform(trained, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))).alias("loss_spans"),
    )


def loss_texts(text: Column, spans: Column, template: Template) -> Column:
    """The texts under the spans, without escapes."""

    def cut(data: Column) -> Column:
        return F.transform(
            spans,
            lambda s: unescaped(
                F.substring(data, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")).cast("string"), template
            ),
        )

    return let(text.cast("binary"), cut)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (role, text), loss (text) and formatted_chars of what `format_conversations` wrote."""
    return formatted.select(
        "conv_id",
        parsed_turns(F.col("text"), template).alias("turns"),
        F.array_join(loss_texts(F.col("text"), F.col("loss_spans"), template), "").alias("loss"),
        F.char_length("text").cast("bigint").alias("formatted_chars"),
    )


PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def chat_formatting(spark, folder) -> DataFrame:
    """Digests of all conversations and of one whose texts are control strings, read back from the written output.

    Nulls, ties, repeated rows and other columns as in `format_conversations`;
    a null role is an empty line of `turns_sha256`.
    """
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], rows.schema)
    back = read_back(saved(format_conversations(rows.unionAll(probe)), "chats"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), marks AS (
    SELECT '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|role\|>|<\|/role\|>|<\|text\|>|<\|/text\|>|[<\[]\\' AS mark
), sized AS (
    SELECT turns.*,
           len(text) + len(regexp_extract_all(text, mark)) + CASE role
               WHEN 'system' THEN len('<<SYS>>  <</SYS>>')
               WHEN 'user' THEN len('[INST]  [/INST]')
               WHEN 'assistant' THEN len('<s>  </s>')
               ELSE len('<|role|>  <|/role|><|text|>  <|/text|>') + len(role) + len(regexp_extract_all(role, mark))
           END AS chars
    FROM turns, marks
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
