"""Repair of damaged conversations at least cost.

A row is a symbol of its role and fault, a conversation the string of its
symbols. What remains of a conversation from some row on is a suffix of that
string, and conversations that end alike share it: read from the end, the
distinct strings of all conversations form an automaton with a node for each
distinct suffix. Sorted by their reversed strings they pass it in depth-first
order, so every node is visited once, with the nodes on the way to it as a
stack. At each node the cheapest way to go on and its first edit are computed
once per state of the grammar.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.resampling import CRC_SQL, CRC_TABLE_SQL
from ledgerloom.llm.storage import saved
from ledgerloom.llm.words import SPACES

# Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# States of the grammar (s?(ua)+)?: nothing yet, after a system, user or assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_WANTED = ("u", "u", "a", "u")
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLES = {"u": "user", "a": "assistant"}
# Symbol of a row that must go; others are s, u, a or x, as capitals where the text is truncated.
MUST_GO = "-"
# Conversations of one signature are joined to its audit in so many groups, as a third of all may share it.
SALTS = 64
# Letters of a reversed signature by which signatures are dealt out.
_RANGE_LETTERS = 64
_BATCH_ROWS, _BATCH_BYTES = 5_000, 4 << 20

Costs = tuple[int, int, int, int]
# Where a conversation ends: after a system row a user and an assistant row are missing, after a user row the latter.
_END: tuple[Costs, str] = ((0, 2 * INSERT, INSERT, 0), ".II.")


def _after(state: int, role: str) -> int:
    """The state after a row of that role in the repaired conversation, which the grammar allows."""
    return SYSTEM if role == "s" and state == START else _NEXT[state]


def _choose(symbol: str, rest: Costs) -> tuple[Costs, str]:
    """Per state the least cost from a row on and the first edit: D(elete), I(nsert), K(eep) or R(erole).

    `rest` has the costs from the next row on. Edits that cost the same are told
    apart by their letter; as each leads to one continuation, that makes the
    whole audit the least in ASCII.
    """
    role, late = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    best = []
    for state in range(4):
        options = [(rest[state] + DELETE, "D")]
        if symbol != MUST_GO:
            if role == _WANTED[state] or (state == START and role == "s"):
                options.append((rest[_after(state, role)] + late, "K"))
            if role != _WANTED[state]:
                options.append((rest[_NEXT[state]] + late + REROLE, "R"))
        best.append(min(options))
    for _ in range(3):  # a row may be inserted before this one, at most one of each role
        best = [min(b, (best[_NEXT[state]][0] + INSERT, "I")) for state, b in enumerate(best)]
    return tuple(b[0] for b in best), "".join(b[1] for b in best)


class SuffixAutomaton:
    """Costs and edits at the suffixes of signatures that are given in the order of their reversed strings.

    It holds the nodes from the end of the last signature to its beginning; a
    node's costs beyond the least of them decide its edits, so equal differences
    share one entry of a table.
    """

    def __init__(self):
        self.symbols = ""  # of the last signature, from its end
        self.costs: list[tuple[int, Costs]] = [(0, _END[0])]
        self.edits: list[str] = [_END[1]]
        self.nodes = 0
        self._known: dict[tuple[str, Costs], tuple[int, Costs, str]] = {}

    def _push(self, symbol: str) -> None:
        base, rest = self.costs[-1]
        found = self._known.get((symbol, rest))
        if found is None:
            costs, edits = _choose(symbol, rest)
            least = min(costs)
            found = self._known[symbol, rest] = (least, tuple(c - least for c in costs), edits)
        least, costs, edits = found
        self.costs.append((base + least, costs))
        self.edits.append(edits)
        self.nodes += 1

    def audit(self, signature: str) -> tuple[int, str]:
        """Cost and edits of the cheapest repair."""
        turned = signature[::-1]
        shared = _shared_length(turned, self.symbols)
        del self.costs[shared + 1 :], self.edits[shared + 1 :]
        for symbol in turned[shared:]:
            self._push(symbol)
        self.symbols = turned
        base, costs = self.costs[-1]
        found, state, depth = [], START, len(turned)
        while (edit := self.edits[depth][state]) != ".":
            found.append(edit)
            if edit in "KD":
                state = _after(state, turned[depth - 1].lower()) if edit == "K" else state
            else:
                state = _NEXT[state]
            depth -= edit != "I"
        return base + costs[START], "".join(found)


def _shared_length(a: str, b: str) -> int:
    """How many first letters are equal, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


# Rows to signatures


def _clean(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest; null roles and texts are one space."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    plain = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *texts)
    return plain.withColumn("digest", F.unhex(F.sha2("text", 256)))


_ORDER = ("turn", "role", "digest")


def row_facts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of the text), blank, cut (its text ends without . ! or ?)."""
    plain = F.rtrim("text", F.lit(SPACES))
    ended = plain.endswith(".") | plain.endswith("!") | plain.endswith("?")
    facts = (plain == "").alias("blank"), (~ended).alias("cut")
    return _clean(rows).select("conv_id", *_ORDER, *facts)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches as tuples, a batch at a time."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


_SIGNATURE = (
    "conv_id bigint, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
)


class _Facts:
    """Signature and counts of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols = conv_id, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.initial = None

    def add(self, turn, role, nth, blank, cut) -> None:
        initial = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        symbol = initial if initial in ("s", "u", "a") else "x"
        if blank:
            self.blank += 1
            symbol = MUST_GO
        elif nth > 1:
            self.duplicate += 1
            symbol = MUST_GO
        elif cut:
            self.truncated += 1
            symbol = symbol.upper()
        self.symbols.append(symbol)
        if len(self.symbols) > 4096:
            self.symbols = ["".join(self.symbols)]

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        counts = self.blank, self.duplicate, self.truncated, self.illegal
        return (self.conv_id, "".join(self.symbols), gaps, *counts)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batches(rows: Iterable[tuple], schema: str, size: Callable[[tuple], int] = lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded size."""
    shape = pa.schema([(name, _ARROW[kind]) for name, kind in (column.split(" ") for column in schema.split(", "))])
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += size(row)
        if len(kept) >= _BATCH_ROWS or held >= _BATCH_BYTES:
            yield _batch(kept, shape)
            kept, held = [], 0
    if kept:
        yield _batch(kept, shape)


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), shape)], schema=shape)


def _signatures(batches):
    def each():
        facts = None
        for conv_id, real, turn, role, nth, blank, cut in _grouped(batches):
            if facts is None or facts.conv_id != conv_id:
                if facts is not None:
                    yield facts.row()
                facts = _Facts(conv_id)
            if real:
                facts.add(turn, role, nth, blank, cut)
        if facts is not None:
            yield facts.row()

    return _batches(each(), _SIGNATURE, lambda row: 64 + len(row[1]))


def signatures(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal of every conversation.

    Conversations of `known` (conv_id) that have no rows get an empty signature.
    Rows are shuffled once without their texts and then stream past in order,
    so of a conversation only one letter a row is held.
    """
    facts = row_facts(rows).withColumn("real", F.lit(True))
    if known is not None:
        # One row per conversation, combined before the shuffle.
        ids = known.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("real", F.lit(False))
        facts = facts.unionByName(ids, allowMissingColumns=True)
    placed = facts.repartition("conv_id")
    alike = Window.partitionBy("conv_id", "real", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    numbered = placed.withColumn("nth", F.row_number().over(alike))
    in_order = numbered.sortWithinPartitions("conv_id", "real", F.col("turn").asc_nulls_first(), "role", "digest", "nth")
    return in_order.select("conv_id", "real", "turn", "role", "nth", "blank", "cut").mapInArrow(_signatures, _SIGNATURE)


def _audits(batches):
    def each():
        automaton = SuffixAutomaton()
        for signature, salts in _grouped(batches):
            cost, audit = automaton.audit(signature)
            yield from ((signature, salt, cost, audit) for salt in salts)

    return _batches(each(), "signature string, salt int, cost bigint, audit string", lambda r: 64 + 2 * len(r[0]))


def audits(signed: DataFrame) -> DataFrame:
    """`signed` (conv_id, signature, ...) with cost and audit, the edits of the cheapest repair.

    Each distinct signature is repaired once, in the order of the reversed
    strings, which are dealt out in ranges. A signature goes back to its
    conversations in up to SALTS groups.
    """
    salted = signed.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    distinct = salted.groupBy("signature").agg(F.collect_set("salt").alias("salts"))
    turned = saved(distinct.withColumn("turned", F.reverse("signature")), "signatures")
    ranges = turned.repartitionByRange(F.substring("turned", 1, _RANGE_LETTERS)).sortWithinPartitions("turned")
    found = ranges.select("signature", "salts").mapInArrow(
        _audits, "signature string, salt int, cost bigint, audit string"
    )
    return salted.join(found, ["signature", "salt"]).drop("salt", "signature")


# Audits to repaired rows

_ABOUT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _applied(batches) -> Iterator[tuple]:
    """The repaired rows in order: conv_id, about, turn, role, text, edit; each conversation begins with its `about`."""
    conv_id = about = None
    audit, at, state = "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield conv_id, None, None, _ROLES[_WANTED[state]], "", "I"
            at, state = at + 1, _NEXT[state]

    for new_id, new_about, turn, role, text in _grouped(batches):
        if new_about is not None:
            yield from inserted()
            conv_id, about = new_id, new_about
            audit, at, state = about["audit"], 0, START
            yield conv_id, about, None, None, None, None
            continue
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        shown = role if edit == "K" else _ROLES[_WANTED[state]]
        yield conv_id, None, turn, shown, text, edit
        state = _after(state, shown[:1])
    yield from inserted()


_REPAIRED = "conv_id bigint, place bigint, turn bigint, role string, text string, edit string"


def _repaired(batches):
    def each():
        place = 0
        for conv_id, about, turn, role, text, edit in _applied(batches):
            place = 0 if about is not None else place + 1
            if place:
                yield conv_id, place, turn, role, text, edit

    return _batches(each(), _REPAIRED, lambda row: 64 + len(row[4]))


_DIGEST = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def _digests(batches):
    def each():
        head, total, empty = None, hashlib.sha256(), True
        for conv_id, about, _, role, text, _ in _applied(batches):
            if about is not None:
                if head is not None:
                    yield (*head, total.hexdigest())
                head, total, empty = (conv_id, *(about[name] for name in _ABOUT)), hashlib.sha256(), True
            else:
                total.update((("" if empty else "\n") + f"{role}:{text}").encode())
                empty = False
        if head is not None:
            yield (*head, total.hexdigest())

    return _batches(each(), _DIGEST, lambda row: 256 + len(row[7]))


def _beside_audits(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Each conversation's audit and counts, followed by its rows in order, in the partitions of one shuffle."""
    found = audits(saved(signatures(rows, known), "signed-conversations"))
    heads = found.select("conv_id", F.struct(*_ABOUT).alias("about"))
    both = heads.unionByName(_clean(rows), allowMissingColumns=True).repartition("conv_id")
    turn = F.col("turn").asc_nulls_first()
    in_order = both.sortWithinPartitions("conv_id", F.col("about").isNull(), turn, "role", "digest")
    return in_order.select("conv_id", "about", "turn", "role", "text")


def repaired_rows(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The rows of `repair` with their texts: conv_id, place (from 1), turn, role, text, edit (I, K or R)."""
    return _beside_audits(rows, known).mapInArrow(_repaired, _REPAIRED)


def repair(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Faults and cheapest repair of every conversation of `rows` (conv_id, turn, role, text) and `known` (conv_id).

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, as the README says. Rows come by turn (null first), rows of
    one turn by role and SHA-256 of the text; a repeated row is a duplicate. Null
    roles and texts are one space, a null conv_id is a conversation, a role is
    judged by its first letter. Conversations without rows have zeros, an empty
    audit and the hash of nothing. Other columns are not read.

    A conversation streams through one task in order, as its hash asks for, with
    one letter per row in memory.
    """
    return _beside_audits(rows, known).mapInArrow(_digests, _DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that a hash of conv_id and turn gives to some.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its . ! ? out,
    3 repeats it, 4 makes it a user's. Nulls are one space, in the hashed key too.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))

    def when(n: int, value: Column, other: Column) -> Column:
        return F.when(kind == n, value).otherwise(other)

    copies = F.array_repeat(F.lit(0), when(3, F.lit(2), F.lit(1)))
    return rows.where(kind != 0).select(
        "conv_id",
        "turn",
        when(4, F.lit("user"), role).alias("role"),
        when(1, F.lit(""), when(2, F.translate(text, ".!?", ""), text)).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def structure_repair(spark, folder) -> DataFrame:
    """The repair of all conversations after damage; odd rows as in `repair` and `damaged`."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), rows.select("conv_id"))


STRUCTURE_SQL = f"""
WITH RECURSIVE crc_tables AS ({CRC_TABLE_SQL}),
kinds AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
), keyed AS (
    SELECT *, {CRC_SQL.replace("KEY", "k")} % 20 AS kind FROM kinds, crc_tables
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM keyed WHERE kind <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
           regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending
    FROM damaged
), faults AS (
    SELECT *, left(role, 1) AS initial, ending = '' AS blank, ending <> '' AND nth > 1 AS duplicate,
           ending NOT IN ('', '.', '!', '?') AND nth = 1 AS truncated
    FROM ordered
), pairs AS (
    SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM faults
), counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
           count_if(previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM pairs GROUP BY conv_id
), costs AS (
    SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS v0, {{'c': 10, 'a': 'II'}} AS v1, {{'c': 5, 'a': 'I'}} AS v2,
           {{'c': 0, 'a': ''}} AS v3
    FROM counts
    UNION ALL
    SELECT conv_id, i, list_min([b0, {{'c': v2.c + 5, 'a': 'I' || v2.a}}]), list_min([b1, {{'c': v2.c + 5, 'a': 'I' || v2.a}}]),
           v2, v3
    FROM (
        SELECT conv_id, i, b0, b1, list_min([b2, {{'c': b3.c + 5, 'a': 'I' || b3.a}}]) AS v2,
               list_min([b3, {{'c': b2.c + 5, 'a': 'I' || b2.a}}]) AS v3
        FROM (
            SELECT c.conv_id, c.i - 1 AS i,
                   list_min([{{'c': v0.c + 2, 'a': 'D' || v0.a}},
                             {{'c': CASE WHEN bad OR initial <> 'u' THEN 1000000 ELSE v2.c + late END, 'a': 'K' || v2.a}},
                             {{'c': CASE WHEN bad OR initial <> 's' THEN 1000000 ELSE v1.c + late END, 'a': 'K' || v1.a}},
                             {{'c': CASE WHEN bad THEN 1000000 ELSE v2.c + late + 1 END, 'a': 'R' || v2.a}}]) AS b0,
                   list_min([{{'c': v1.c + 2, 'a': 'D' || v1.a}},
                             {{'c': CASE WHEN bad OR initial <> 'u' THEN 1000000 ELSE v2.c + late END, 'a': 'K' || v2.a}},
                             {{'c': CASE WHEN bad THEN 1000000 ELSE v2.c + late + 1 END, 'a': 'R' || v2.a}}]) AS b1,
                   list_min([{{'c': v2.c + 2, 'a': 'D' || v2.a}},
                             {{'c': CASE WHEN bad OR initial <> 'a' THEN 1000000 ELSE v3.c + late END, 'a': 'K' || v3.a}},
                             {{'c': CASE WHEN bad THEN 1000000 ELSE v3.c + late + 1 END, 'a': 'R' || v3.a}}]) AS b2,
                   list_min([{{'c': v3.c + 2, 'a': 'D' || v3.a}},
                             {{'c': CASE WHEN bad OR initial <> 'u' THEN 1000000 ELSE v2.c + late END, 'a': 'K' || v2.a}},
                             {{'c': CASE WHEN bad THEN 1000000 ELSE v2.c + late + 1 END, 'a': 'R' || v2.a}}]) AS b3
            FROM costs c JOIN (
                SELECT conv_id, i, initial, blank OR duplicate AS bad, CASE WHEN truncated THEN 5 ELSE 0 END AS late FROM faults
            ) f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.i = f.i
        )
    )
), best AS (
    SELECT conv_id, v0.c AS cost, v0.a AS audit FROM costs WHERE i = 0
), edits AS (
    SELECT conv_id, unnest(range(1, len(audit) + 1)) AS k, substr(audit, unnest(range(1, len(audit) + 1)), 1) AS edit FROM best
), steps AS (
    SELECT *, count_if(edit <> 'I') OVER upto AS i, count_if(edit <> 'D') OVER upto AS e
    FROM edits WINDOW upto AS (PARTITION BY conv_id ORDER BY k)
), shown AS (
    SELECT s.conv_id, s.k, s.e, s.edit, f.role, CASE s.edit WHEN 'I' THEN '' ELSE f.text END AS text,
           max(CASE WHEN s.e = 1 AND s.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS led
    FROM steps s LEFT JOIN faults f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.i = f.i AND s.edit <> 'I'
    WHERE s.edit <> 'D'
), repaired AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || text, chr(10) ORDER BY k) AS whole
    FROM shown GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""
