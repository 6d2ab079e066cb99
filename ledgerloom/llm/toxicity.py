"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: case, accents, letters that look alike and digits or
signs in place of letters. The lexicon holds whole words and beginnings of
words with weights learnt from labels; phrases seen in clean texts excuse the
words in them. The sum of the weights per word gives the score.
"""

from __future__ import annotations

import collections
import dataclasses
import functools
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.labels import held_out, label_sample
from ledgerloom.llm.storage import saved

# Labelled rows to learn from, per label.
SAMPLE = 5000
# Texts with a term, rate against clean texts, and terms in all that a lexicon needs or may have.
SUPPORT = 5
RATIO = 10
TERMS = 4000
# A toxic text asks for no more terms once so many match it.
COVER = 2
PREFIXES = (4, 5, 6)
# Phrases that excuse a word in them, beside those learnt.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "circus clown", "clown fish")

# Letters that look like Latin ones: Cyrillic, Greek and others.
_ALIKE = {
    "a": "аαɑ",
    "b": "вβ",
    "c": "с",
    "d": "ԁđð",
    "e": "еєε",
    "g": "ɡ",
    "h": "нһħ",
    "i": "іɩıι",
    "j": "ј",
    "k": "кκ",
    "l": "łʟ",
    "m": "м",
    "n": "пη",
    "o": "оοøσ",
    "p": "рρ",
    "q": "ԛ",
    "r": "г",
    "s": "ѕ",
    "t": "тτ",
    "u": "υ",
    "v": "νѵ",
    "w": "ԝω",
    "x": "хχ",
    "y": "уγ",
    "ss": "ß",
    "ae": "æ",
    "oe": "œ",
}
# Digits in place of letters; 1 may stand for i or l, so these are one letter here.
_DIGITS = str.maketrans("01345789l", "oieastbgi")
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
_SIGN = re.compile(r"(?<![@$!|€£])[@$!|€£](?=[^\W_])")
# Accents split off their letters, soft hyphens, and characters without width.
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]+")
_WORDS = re.compile(r"[^\W_]+")
_LETTERS = str.maketrans({letter: latin for latin, letters in _ALIKE.items() for letter in letters})


def fold(text: str | None) -> str:
    """The folded words of a text between single spaces, with a space at either end."""
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_LETTERS)
    if _SIGN.search(text):
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    return f" {' '.join(_WORDS.findall(text.translate(_DIGITS)))} "


@dataclasses.dataclass(frozen=True)
class Lexicon:
    """Weights of terms (" word " or the beginning " wor"), phrases that excuse, and the scale of the score."""

    weights: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    intercept: float = -10.0
    slope: float = 0.0

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in self.weights:
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), None))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def matches(self, folded: str) -> dict[int, float]:
        """Weight of each matching word by its place; the heaviest term of a word counts."""
        if self.automaton is None:
            return {}
        found: dict[int, float] = {}
        excused = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        for start, end in excused:
            for place in [p for p in found if start <= p < end]:
                del found[place]
        return found

    def density(self, folded: str) -> float:
        """Sum of the weights per word; 0 for a text without words."""
        found = self.matches(folded)
        return sum(found.values()) / max(1, folded.count(" ") - 1) if found else 0.0

    def score(self, density: float) -> float:
        return float(1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(1000 * density)))))


def _terms(folded: str) -> set[str]:
    """The terms a text offers: its words, and the beginnings of longer ones."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for size in PREFIXES:
        found.update(f" {w[:size]}" for w in words if len(w) > size)
    return found


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [fold(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["label", "text"])


def _counted(keys_of):
    """Rows of key, toxic, clean: in how many texts of either label a key is, summed up per batch."""
    names = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches):
        for batch in batches:
            found = (collections.Counter(), collections.Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].update(keys_of(text))
            keys = list(found[0] | found[1])
            columns = [keys, [found[1][k] for k in keys], [found[0][k] for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names.types, strict=True)], schema=names)

    return count


def _counts(sample: DataFrame, keys_of) -> DataFrame:
    found = sample.mapInArrow(_counted(keys_of), "term string, toxic bigint, clean bigint")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _matched(terms: Sequence[str]):
    """Per text a hash of it and the places of its terms in the list."""
    place = {t: i for i, t in enumerate(terms)}

    def match(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [sorted(place[t] for t in _terms(x) & place.keys()) for x in texts]
            prints = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in texts]
            columns = [pa.array(prints, pa.binary()), pa.array(rows, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["print", "places"])

    return match


def cover(
    texts: Iterable[Sequence[int]], costs: Sequence[float], times: int = COVER, support: int = SUPPORT
) -> list[int]:
    """Terms in the order chosen: the one in most texts that fewer than `times` others match so far, less its cost.

    Words that merely come along with others in a few texts are thus not
    chosen, nor are terms that cost as much as they bring.
    """
    rows = [t for t in texts if len(t)]
    there = np.zeros((len(rows), len(costs)), bool)
    for i, row in enumerate(rows):
        there[i, list(row)] = True
    left = np.full(len(rows), times)
    chosen: list[int] = []
    counts, costs = there.sum(axis=0), np.asarray(costs, float)
    while True:
        gain = np.where(counts >= support, counts - costs, 0)
        if not gain.size or gain.max() <= 0:
            return chosen
        best = int(gain.argmax())
        chosen.append(best)
        hit = there[:, best].copy()
        left[hit] -= 1
        done = hit & (left == 0)
        there[:, best] = False
        counts[best] = 0
        counts = counts - there[done].sum(axis=0)
        there[done] = False


def _phrases(lexicon: Lexicon):
    def phrases(folded: str) -> set[str]:
        words, found = folded.split(), set()
        starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
        at = {s: i for i, s in enumerate(starts)}
        for start in lexicon.matches(folded):
            i = at[start]
            found.update(f"{a} {b}" for a, b in itertools.pairwise(words[max(0, i - 1) : i + 2]))
        return found

    return phrases


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps with a little damping."""
    rows, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curve, rows.T @ (y - p) - 1e-2 * beta), -3, 3)
    return float(beta[0]), float(beta[1])


def _densities(lexicon: Lexicon):
    def measure(batches):
        for batch in batches:
            found = [lexicon.density(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["label", "density"])

    return measure


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """The lexicon learnt from about `sample` labelled texts of each label; held-out rows are not read.

    Without texts of both labels the lexicon is empty and all scores are near 0.
    """
    known = label_sample(labels, "toxic", sample)
    texts = docs.select("doc_id", "text").join(known, "doc_id").select("label", "text")
    folded = saved(texts.mapInArrow(_folded, "label int, text string"), "toxicity-sample")
    sizes = {row["label"]: row["n"] for row in folded.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    rate = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    terms = _counts(folded, _terms).where((F.col("toxic") >= SUPPORT) & (rate >= RATIO))
    terms = terms.orderBy(F.desc("toxic"), "clean", "term").limit(TERMS).collect()
    matched = folded.where("label = 1").mapInArrow(_matched([t["term"] for t in terms]), "print binary, places array<int>")
    texts = {bytes(r["print"]): r["places"] for r in matched.collect()}  # copies count once
    # A clean text with the term weighs like four toxic ones; whole words go before beginnings that add little.
    costs = [4 * t["clean"] * toxic / clean + 2 * (t["term"][-1] != " ") for t in terms]
    chosen = [terms[i] for i in cover([texts[p] for p in sorted(texts)], costs)]

    def weight(t):
        inside, outside = (t["toxic"] + 0.5) / (toxic - t["toxic"] + 0.5), (t["clean"] + 0.5) / (clean - t["clean"] + 0.5)
        return float(np.log(inside / outside))

    lexicon = Lexicon(tuple((t["term"], weight(t)) for t in chosen), tuple(exceptions))
    harmless = _counts(folded, _phrases(lexicon)).where((F.col("clean") >= 3) & (F.col("toxic") * 10 <= F.col("clean")))
    learnt = [r["term"] for r in harmless.orderBy(F.desc("clean"), "term").limit(TERMS).collect()]
    lexicon = dataclasses.replace(lexicon, exceptions=(*exceptions, *learnt))
    found = folded.mapInArrow(_densities(lexicon), "label int, density double").collect()
    x, y = np.log1p(1000 * np.array([r["density"] for r in found])), np.array([r["label"] for r in found], float)
    intercept, slope = _fit(x, y)
    return dataclasses.replace(lexicon, intercept=intercept, slope=slope)


def _scores(lexicon: Lexicon):
    def score(batches):
        for batch in batches:
            found = [lexicon.score(lexicon.density(fold(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return score


def toxicity_scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts have the score of a text without matches.

    Rows of one doc_id are scored one by one; other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    return narrow.mapInArrow(_scores(lexicon), "doc_id bigint, score double")


def toxicity(spark, folder) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lexicon = learn_lexicon(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = toxicity_scores(docs, lexicon)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
