"""Spelling variants: words that differ by one letter, grouped under their most frequent form.

1. Tasks count the runs of letters of their texts; the counts are added by word (combined before they move, so a word that every text has
   costs one row a task).
2. Symmetric deletes: every word emits a hash of itself and of each of its distinct single deletions. Words that share a key are joined, and the pairs that
   differ by exactly one inserted, deleted or replaced letter are kept; the words themselves are compared, so keys that collide do no harm. A key of c letters is shared by no more
   words than one letter can be put into it in ways (c + 1 times the alphabet), so no group of the join grows with the data.
3. The near words of a word are counted, and its form is its most frequent near word, if that is frequent enough.
4. Links from words to forms are joined with themselves until all point to roots: each round doubles how far they reach, and a form is at least `ratio` times as
   frequent as the word, so a few rounds do.

Hashes of deletions are differences of running sums, so a word of n letters costs n keys of 8 bytes, however long it is; words of more than SHORT letters
do not travel with their keys: they are looked up for the pairs that their keys found.

Defined results: null and empty texts have no words; an id that is null changes no run; rows that share an id are different rows; an empty table gives
an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrow import in_batches
from quillspark.llm.terms import lowered, spans
from quillspark.llm.text import SEQUENCE_BASE, content, mix, pieces, powers
from quillspark.sources.scratch import discard, written

#: Letters of the longest word that travels with its keys.
SHORT = 48
#: Text handled at once; a longer text is a piece of its own.
PIECE = 2 << 20
# A-Z, a-z, and the first byte of U+00C0 to U+00FF in UTF-8, whose second byte is a letter's too.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a letter."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    return inside


def count_runs(least: int, drop_every: int | None):
    """Texts to words of `least` letters or more, with how often they occur in a piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                data, offsets = content(piece.column("text"))
                inside = letters(data)
                starts, ends, of = spans(inside, offsets)
                if not len(starts):
                    continue
                runs = lowered(data, inside, starts, ends).dictionary_encode()
                words = runs.dictionary
                sizes = pc.utf8_length(words.cast(pa.large_string())).to_numpy()
                codes = runs.indices.to_numpy().astype(np.int64)
                long = sizes[codes] >= least
                found, n = np.unique(of[long] * len(words) + codes[long], return_counts=True)
                doc, code = found // len(words), found % len(words)
                text = words.to_pylist()
                counts = np.zeros(len(words), np.int64)
                changed: dict[str, int] = {}
                if drop_every:
                    begun = [None if d is None else crc32(f"{d}:".encode()) for d in piece.column("id").to_pylist()]
                    hashes = [None if (b := begun[d]) is None else crc32(text[c], b) for d, c in zip(doc.tolist(), code.tolist())]
                    drop = np.array([h is not None and h % drop_every == 0 for h in hashes], bool)
                    for i in np.flatnonzero(drop).tolist():
                        word = text[code[i]].decode()
                        at = hashes[i] % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            changed[word] = changed.get(word, 0) + int(n[i])
                    code, n = code[~drop], n[~drop]
                np.add.at(counts, code, n)
                kept = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(kept)).cast(pa.string()), pa.array(counts[kept])], names=["word", "n"])
                if changed:
                    yield pa.RecordBatch.from_arrays([pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, least: int = 5, support: int = 3, drop_every: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of the runs of letters (A-Z in lower case) of at least `least` letters that occur `support` times or more.

    drop_every: of a document's runs that share a hash with so many others, one letter is left out first (misspellings of a known share).
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    counted = in_batches(rows, count_runs(least, drop_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)


def deletion_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to hashes of themselves and of their distinct single deletions."""
    for batch in batches:
        for piece in pieces(batch, "word"):
            points = np.frombuffer("".join(piece.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
            sizes = pc.utf8_length(piece.column("word")).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            up, down = powers(SEQUENCE_BASE, len(points) + 1)
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
            starts, ends, of = edges[:-1], edges[1:], np.repeat(np.arange(len(sizes)), sizes)
            whole = (sums[ends] - sums[starts]) * down[starts]
            at = np.arange(len(points))
            if len(at):  # leaving out any letter of a run of equal ones gives the same word
                repeats = np.zeros(len(points), bool)
                repeats[1:] = (points[1:] == points[:-1]) & (of[1:] == of[:-1])
                at, of = at[~repeats], of[~repeats]
            shorter = (sums[at] - sums[starts[of]] + (sums[ends[of]] - sums[at + 1]) * down[1]) * down[starts[of]]
            row = pa.array(np.concatenate([np.arange(len(sizes)), of]))
            short = np.where(sizes <= SHORT, True, False)
            word = pc.if_else(pa.array(short), piece.column("word"), pa.scalar(None, pa.string()))
            keys = pa.array(mix(np.concatenate([whole, shorter])).view(np.int64))
            yield pa.RecordBatch.from_arrays([keys, piece.column("id").take(row), word.take(row), piece.column("n").take(row)], names=["key", "id", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """id, near_id, near_word, near_n for each two words (id, word, n) that differ by one letter, both ways round."""
    keys = in_batches(words, deletion_keys, "key long, id long, word string, n long")
    one = lambda a, b: F.levenshtein(a, b, 1) == 1
    a, b = keys.toDF("key", "a", "a_word", "a_n"), keys.toDF("key_b", "b", "b_word", "b_n")
    sure = F.col("a_word").isNotNull() & F.col("b_word").isNotNull()
    met = a.join(b, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (~sure | one(F.col("a_word"), F.col("b_word"))))
    found = written(met.select("a", "b", "a_word", "b_word", "a_n", "b_n").distinct(), "spelling-pairs")
    texts = lambda side: words.select(F.col("id").alias(side), F.col("word").alias(f"{side}_text"))
    looked_up = found.filter(~sure).join(texts("a"), "a").join(texts("b"), "b").filter(one(F.col("a_text"), F.col("b_text")))
    both = found.filter(sure).unionByName(looked_up.select("a", "b", F.col("a_text").alias("a_word"), F.col("b_text").alias("b_word"), "a_n", "b_n"))
    sides = [F.struct(F.col(x).alias("id"), F.col(y).alias("near_id"), F.col(f"{y}_word").alias("near_word"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]
    return both.select(F.inline(F.array(*sides)))


def roots(links: DataFrame) -> DataFrame:
    """id and root of links (id, form): where following forms ends. Pointers are joined with themselves, so each round doubles their reach."""
    at = written(links.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        moved = written(at.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        discard(at)
        if moved.filter("moved").isEmpty():
            return moved.select("id", "root")
        at = moved.drop("moved")
        at.scratch = moved.scratch


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """words (word, n) with form, root, n_near and form_n."""
    numbered = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    best = F.min_by(F.struct("near_id", "near_word", "near_n"), F.struct(-F.col("near_n"), "near_word")).alias("best")
    near = near_words(numbered).groupBy("id").agg(F.count("*").alias("n_near"), best)
    frequent = F.col("best.near_n") >= ratio * F.col("n")
    formed = numbered.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best")).alias("best"))
    formed = written(formed, "spelling-forms")
    ends = roots(formed.filter("best is not null").select("id", F.col("best.near_id").alias("form")))
    named = ends.join(numbered.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = formed.join(named, "id", "left")
    return out.select("word", F.col("best.near_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", F.col("best.near_n").alias("form_n"))


def variant_report(docs: DataFrame) -> DataFrame:
    """The variants of the words of docs, where one run in 97 has a letter left out."""
    return variants(word_counts(docs, drop_every=97))


SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS step),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda b: ('0x' || b)::BIGINT),
    lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h FROM runs, crc WHERE length(run) >= 5),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (
  SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT s.word, w.word AS other, w.n FROM shorter s JOIN words w ON s.key = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.key = w.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN shorter b ON a.key = b.key AND a.p = b.p AND a.word <> b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(struct_pack(other := other, n := n), struct_pack(m := -n, o := other)) AS top FROM near GROUP BY word),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 2 * words.n THEN top.other END AS form, CASE WHEN top.n >= 2 * words.n THEN top.n END AS form_n
  FROM words LEFT JOIN best USING (word)),
followed AS (
  WITH RECURSIVE way AS (
    SELECT word, word AS here, form AS next FROM formed
    UNION ALL SELECT way.word, formed.word, formed.form FROM way JOIN formed ON way.next = formed.word)
  SELECT word, here AS root FROM way WHERE next IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN followed USING (word)
"""
