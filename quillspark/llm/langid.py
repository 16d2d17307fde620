"""Language of a text, by words first and character n-grams for the rest.

A known word scores its log frequency in each language. A word that the model hasn't seen scores the mean log frequency of its longest known
character n-grams: of 5 characters if any of those is known, else of 4, and so on. The language with the largest sum over all words of the
text is predicted, with its posterior probability as the score.

The model is fitted on a sample of labelled rows: about SAMPLE of each language, drawn by a hash of the id, which bounds its size. It knows every word and n-gram that the
sample has twice; of what was seen once its parts tell more. Prediction covers every word of every text.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text if there was nothing to learn from; ties go to the
language that comes first by code point. Other columns are carried along, but for those with the name of an added one, which that replaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrow import in_batches, numbered, renamed
from quillspark.sources.scratch import written
from quillspark.llm.text import pieces

SAMPLE, LONGEST = 1_500, 5
#: Space-separated strings whose scores a worker remembers, and their code points at most.
REMEMBERED, REMEMBERED_LENGTH = 80_000, 48
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(token: str) -> list[str]:
    if token.isalpha():
        return [token]
    return [w for w in _LETTERS.findall(token) if any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, tuple[float, ...]]
    grams: list[dict[str, tuple[float, ...]]]  # by length; the first is empty

    def score(self, token: str) -> list[float] | tuple[float, ...] | None:
        """The sum over the words of a space-separated string; None if it has no letter."""
        words = letter_words(token)
        if len(words) == 1:
            return self.words.get(words[0]) or self.back_off(words[0])
        each = [self.words.get(w) or self.back_off(w) for w in words]
        return [sum(scores) for scores in zip(*each)] if each else None

    def back_off(self, word: str) -> list[float]:
        marked = f"<{word}>"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            find = self.grams[n].get
            known = 0
            sums = [0.0] * len(self.languages)
            for i in range(len(marked) - n + 1):
                if (found := find(marked[i : i + n])) is not None:
                    known += 1
                    sums = [a + b for a, b in zip(sums, found)]
            if known:
                return [x / known for x in sums]
        return [0.0] * len(self.languages)


def log_frequencies(counts: dict[str, dict[str, int]], languages: list[str]) -> dict[str, tuple[float, ...]]:
    """For each unit its smoothed log frequency in each language, less the mean over languages."""
    total = {lang: sum(c.get(lang, 0) for c in counts.values()) + 0.5 * len(counts) for lang in languages}
    found = {}
    for unit, c in counts.items():
        logs = [log((c.get(lang, 0) + 0.5) / total[lang]) for lang in languages]
        found[unit] = tuple(x - sum(logs) / len(logs) for x in logs)
    return found


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            seen: dict[str, Counter] = {}
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(text.lower().split())
            out = Counter()
            for lang, tokens in seen.items():
                for token, n in tokens.items():
                    for word in letter_words(token):
                        out[lang, word] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out]), pa.array([k[1] for k in out]), pa.array(list(out.values()), pa.int64())], schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    out[lang, size, gram] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))] + [pa.array(list(out.values()), pa.int64())], names=["lang", "size", "word", "n"])


def counts_of(counts: DataFrame) -> dict[str, dict[str, int]]:
    """The counts by language of the units that the sample has twice; the sample bounds the rows that come to the driver."""
    by_unit = counts.groupBy("word").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    return {r.word: r.by for r in by_unit.filter("all > 1").select("word", "by").collect()}


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from labelled rows; rows without text or language aren't used."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key).alias("draw")).filter("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model([], {}, [{}] * (LONGEST + 1))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 20, (SAMPLE << 20) // n))])
    sample = rows.filter(F.pmod("draw", F.lit(1 << 20)) < share[F.col("lang")])
    words = in_batches(sample.select("lang", "text"), count_words, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = sorted(sizes)
    known = log_frequencies(counts_of(words), languages)
    every = in_batches(words, count_grams, "lang string, size int, word string, n long")
    every = written(every.groupBy("lang", "size", "word").agg(F.sum("n").alias("n")), "langid-grams")
    by_size = [log_frequencies(counts_of(every.filter(F.col("size") == n)), languages) if n else {} for n in range(LONGEST + 1)]
    return Model(languages, known, by_size)


class Scores:
    """Score vectors of the strings seen lately, as rows of a matrix; row 0 is for strings without letters."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row, self.used = {}, 1
        self.matrix = np.zeros((1024, len(self.model.languages)))

    def add(self, token: str) -> int:
        found = self.model.score(token)
        at = 0
        if found is not None:
            if self.used == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            at, self.used = self.used, self.used + 1
            self.matrix[at] = found
        if len(token) <= REMEMBERED_LENGTH:
            self.row[token] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages:
            return "und", 0.0
        if max(self.used, len(self.row)) > REMEMBERED:
            self.clear()
        row, add = self.row.get, self.add
        rows = [add(t) if (r := row(t)) is None else r for t in text.lower().split()]
        if not any(rows):
            return "und", 0.0
        sums = self.matrix[rows].sum(0)
        best = int(sums.argmax())
        return self.model.languages[best], float(1 / np.exp(sums - sums[best]).sum())


def predicted(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score; carry: the columns to keep, if not all."""
    carry = docs.columns if carry is None else carry
    return renamed(_predicted(docs, model, text, carry), carry, 2)


def _predicted(docs: DataFrame, model: Model, text: str, carry: list[str]) -> DataFrame:
    """The columns to carry, numbered, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain, names = numbered(docs)
    at = names[docs.columns.index(text)]
    kept = [names[docs.columns.index(c)] for c in carry]
    schema = plain.select(kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for batch in batches:
            for part in pieces(batch, at):
                found = [scores.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    return in_batches(plain, run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs, by a model fitted on the rows that aren't held out."""
    model = fit(docs.filter(~held_out()))
    found = predicted(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is in a language that the model knows; `und` goes."""
    model = fit(docs.filter(~held_out()))
    found = _predicted(docs, model, "text", docs.columns).filter("lang_pred <> 'und'")
    return found.drop("lang_pred", "score").toDF(*docs.columns)
