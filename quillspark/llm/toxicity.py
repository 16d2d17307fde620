"""Toxicity by a learned lexicon, matched with misspellings, in context.

1. The lexicon is learned from labelled rows: words, and beginnings of words (stems), that toxic texts have and others hardly have, in
   both halves of a sample.
2. The words of a text are matched against the lexicon by the intersection of Levenshtein automata with the lexicon's trie: one walk
   over a word follows all terms at once, for as long as one of them is within its number of edits. The intersection's states are
   made deterministic as they are met.
3. Each hit is weighed by its window of words: quotation marks and words of reporting lower it, direct address raises it.
4. A logistic regression on the sample turns a text's hits into a score.

Fitting uses SAMPLE labelled rows of each class at most (about; drawn by a hash of the id) and keeps TERMS terms. Scores cover every word of every text.

Defined results: null and empty texts have no hits and get the score of a text without hits, as every text does if there was no label of
either class to learn from (0 then). Rows with a null label aren't learned from. Other columns are carried along, but for a score, which the new one replaces.
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
from quillspark.llm.text import pieces

SAMPLE, TERMS = 12_000, 400
STEM_LENGTHS = range(4, 9)
#: A term has this many toxic texts in all, one in each half at least, and is so much more frequent in toxic texts (log of the ratio);
#: from FULL_RATIO on it has its full weight. A misspelled term has the weight MISSPELLED.
SUPPORT, LOG_RATIO, FULL_RATIO, MISSPELLED = 4, 1.8, 5.0, 0.6
#: Words on both sides of a hit that tell how it's meant.
WINDOW = 8
REMEMBERED = 120_000
#: States of the automaton that a worker keeps; beyond, it starts again from the first one.
KEPT_STATES = 20_000
FEATURES = 6
# Words of reporting and of direct address, in the four languages of the tables.
REPORTING = set("said says say wrote writes quote quoted quotes called term word according reported replied asked dit écrit cité selon mot sagte schrieb zitat zitierte laut wort dijo escribió cita citó según palabra".split())
ADDRESS = set("you your you're u ur tu toi vous ton ta tes du dich dir dein deine ihr tú ti eres usted ustedes".split())
_QUOTES = re.compile("[\"“”„«»‘‹›]")
_PARTS = re.compile(r"\w+")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


@dataclass
class Lexicon:
    """words: whole terms; stems: beginnings of words; each with its weight, up to 1."""

    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        """Of a word that is a term or begins with a stem (the longest counts)."""
        stem = next((self.stems[word[:n]] for n in range(len(word), 0, -1) if word[:n] in self.stems), 0.0)
        return max(self.words.get(word, 0.0), stem)


class Automaton:
    """The Levenshtein automata of all terms, run along the trie of the terms."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}  # node of a whole term: its allowed edits
        self.stem_at: dict[int, int] = {}
        self.reach = [0]  # the most edits that a term below a node allows
        for terms, ends in ((lexicon.words, self.word_at), (lexicon.stems, self.stem_at)):
            for term in terms:
                node, allowed = 0, edits_allowed(term)
                self.reach[0] = max(self.reach[0], allowed)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.reach.append(0)
                    node = self.children[node][c]
                    self.reach[node] = max(self.reach[node], allowed)
                ends[node] = allowed
        self.letters = {c for node in self.children for c in node}
        self.forget()

    def forget(self) -> None:
        """Back to the first state alone."""
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []  # the least edits of a whole term that ends here; -1: none
        self.caught: list[int] = []  # the same for a stem
        self.start = self.state(self.closed({0: 0}))

    def closed(self, nodes: dict[int, int]) -> frozenset:
        """With the nodes that follow by leaving out letters of a term."""
        open_ = list(nodes)
        while open_:
            node = open_.pop()
            edits = nodes[node] + 1
            for child in self.children[node].values():
                if edits <= self.reach[child] and edits < nodes.get(child, 99):
                    nodes[child] = edits
                    open_.append(child)
        return frozenset(nodes.items())

    def state(self, nodes: frozenset) -> int:
        if nodes not in self.number:
            self.number[nodes] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            for ends, found in ((self.word_at, self.accepts), (self.stem_at, self.caught)):
                edits = [e for node, e in nodes if node in ends and e <= ends[node]]
                found.append(min(edits, default=-1))
        return self.number[nodes]

    def step(self, state: int, letter: str) -> int:
        """The next state, -1 if no term is left."""
        nodes: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.reach[node] and edits < nodes.get(node, 99):
                nodes[node] = edits

        for node, edits in self.states[state]:
            put(node, edits + 1)
            for c, child in self.children[node].items():
                put(child, edits + (c != letter))
        found = self.moves[state][letter] = self.state(self.closed(nodes)) if nodes else -1
        return found

    def edits(self, word: str) -> int:
        """The fewest edits that turn word into a term, or its beginning into a stem; -1 if none is near enough."""
        if len(self.states) > KEPT_STATES:
            self.forget()
        state, best = self.start, -1
        for c in word:
            letter = c if c in self.letters else ""
            following = self.moves[state].get(letter)
            state = self.step(state, letter) if following is None else following
            if state < 0:
                return best
            if (stem := self.caught[state]) >= 0 and (best < 0 or stem < best):
                best = stem
                if best == 0:
                    return 0
        whole = self.accepts[state]
        return whole if best < 0 or 0 <= whole < best else best


class Matcher:
    """Space-separated strings to how near they are to a term; remembers what it has seen lately."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.automaton = lexicon, Automaton(lexicon)
        self.seen: dict[str, float] = {}

    def add(self, token: str) -> float:
        """0: no term; above: the weight of a term; below: less the weight of a misspelled term."""
        parts = _PARTS.findall(token)
        if len(parts) > 1 or (parts and parts[0] != token):
            parts.append(token.strip("\"“”„«»‘’‹›'.,;:!?()[]{}-–—*_~`|/\\"))
        found = [(e, p) for p in parts if (e := self.automaton.edits(p)) >= 0]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        exact = max((self.lexicon.weight(p) for e, p in found if e == 0), default=0.0)
        value = self.seen[token] = exact or (-MISSPELLED if found else 0.0)
        return value

    def features(self, text: str | None) -> list[float]:
        """Hits that are meant, misspelled ones too, quoted ones, those of the densest window, those of 100 words (all weighed, on a log scale); the largest weight."""
        tokens = (text or "").lower().split()
        seen, add = self.seen.get, self.add
        kinds = [add(t) if (k := seen(t)) is None else k for t in tokens]
        at = [i for i, k in enumerate(kinds) if k]
        if not at:
            return [0.0] * FEATURES
        meant = fuzzy = quoted = 0.0
        weights = []
        for i in at:
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            meaning = self.meaning(near, min(i, WINDOW))
            weights.append(meaning * abs(kinds[i]))
            if meaning < 0.5:
                quoted += 1
            else:
                meant += weights[-1]
                fuzzy += weights[-1] * (kinds[i] < 0)
        dense, end = 0.0, 0
        for start, i in enumerate(at):
            while end < len(at) and at[end] <= i + WINDOW:
                end += 1
            dense = max(dense, sum(weights[start:end]))  # of WINDOW + 1 hits at most
        return [log(1 + meant), log(1 + fuzzy), log(1 + quoted), log(1 + dense), log(1 + 100 * meant / len(tokens)), max(weights)]

    @staticmethod
    def meaning(near: list[str], i: int) -> float:
        """From 0 (a quotation) to 1.5 (said to someone), from the words around near[i]."""
        before = sum(len(_QUOTES.findall(t)) for t in near[:i]) + len(_QUOTES.findall(near[i][:1]))
        after = sum(len(_QUOTES.findall(t)) for t in near[i + 1 :]) + len(_QUOTES.findall(near[i][1:]))
        bare = {t.strip(".,;:!?\"'“”«»") for t in near}
        weight = 1.0 + 0.5 * bool(bare & ADDRESS)
        if before % 2 and after:
            weight -= 0.7
        if bare & REPORTING:
            weight -= 0.4
        return max(weight, 0.0)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of the features, then the constant

    def score(self, features: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot([*features, 1.0], self.weights), -30, 30))))


def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each half and class have each word and each stem (marked by a star)."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            out: Counter = Counter()
            for toxic, half, text in zip(*(piece.column(c).to_pylist() for c in ("toxic", "half", "text"))):
                words = {w for w in _PARTS.findall(text.lower()) if 4 <= len(w) <= 24}
                stems = {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}
                out.update((u, 2 * toxic + half) for u in words | stems)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["unit", "kind", "n"])


def learn_lexicon(sample: DataFrame, sizes: list[int]) -> Lexicon:
    """sizes: texts of (clean, toxic)."""
    counted = in_batches(sample, count_units, "unit string, kind int, n long")
    each = [F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(f"k{i}") for i in range(4)]
    by_unit = counted.groupBy("unit").agg(*each).filter((F.col("k2") + F.col("k3") >= SUPPORT) & (F.col("k2") > 0) & (F.col("k3") > 0))
    ratio = F.log((F.col("k2") + F.col("k3") + 0.5) / (sizes[1] + 1)) - F.log((F.col("k0") + F.col("k1") + 0.5) / (sizes[0] + 1))
    toxic = (F.col("k2") + F.col("k3")).alias("toxic")
    best = by_unit.select("unit", toxic, ratio.alias("ratio")).filter(F.col("ratio") >= LOG_RATIO).orderBy(F.desc("toxic"), "unit").limit(20 * TERMS).collect()
    counts, ratios = {r.unit: r.toxic for r in best}, {r.unit: r.ratio for r in best}
    # a stem that one longer unit accounts for gives way to it; what a remaining stem covers goes
    longest: dict[str, int] = {}
    for unit, n in counts.items():
        base = unit.rstrip("*")
        for size in STEM_LENGTHS:
            if size < len(base) or (size == len(base) and not unit.endswith("*")):
                stem = base[:size] + "*"
                longest[stem] = max(longest.get(stem, 0), n)
    units = {u for u, n in counts.items() if not u.endswith("*") or longest.get(u, 0) < 0.9 * n}
    stems = sorted((u[:-1] for u in units if u.endswith("*")), key=len)
    taken: list[str] = []
    for stem in stems:
        if not any(stem.startswith(t) for t in taken):
            taken.append(stem)
    # a word that a stem covers stands by itself if it says clearly more
    covering = {u: next((t for t in taken if u.startswith(t)), None) for u in units if not u.endswith("*")}
    words = [u for u, t in covering.items() if t is None or ratios[u] >= ratios[t + "*"] + 0.7]
    ranked = sorted([(-counts[w], w, w) for w in words] + [(-counts[s + "*"], s, s + "*") for s in taken])[:TERMS]
    weights = {u: min(1.0, ratios[u] / FULL_RATIO) for _, _, u in ranked}
    return Lexicon({u: w for u, w in weights.items() if not u.endswith("*")}, {u[:-1]: w for u, w in weights.items() if u.endswith("*")})


def regress(features: np.ndarray, labels: np.ndarray, penalty: float = 0.02, steps: int = 60) -> np.ndarray:
    """Logistic regression with a small quadratic penalty, by Newton's steps."""
    x = np.column_stack([features, np.ones(len(features))])
    weights = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (labels - p) - ridge @ weights
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def features_of(matcher: Matcher, texts: list[str | None]) -> np.ndarray:
    return np.array([matcher.features(t) for t in texts], float).reshape(-1, FEATURES)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the texts of docs (doc_id, text) with labels (doc_id, toxic); None if either class is missing."""
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"), draw.alias("draw")).filter("doc_id is not null and toxic in (0, 1)")
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1 << 20, (SAMPLE << 20) // sizes[1])).otherwise(min(1 << 20, (SAMPLE << 20) // sizes[0]))
    drawn = known.filter(F.pmod("draw", F.lit(1 << 20)) < share).select("doc_id", "toxic", F.shiftright("draw", 40).bitwiseAND(F.lit(1)).cast("int").alias("half"))
    # about 2 * SAMPLE rows of 20 bytes, so their broadcast is bounded
    sample = docs.select("doc_id", F.col("text")).filter("text is not null").join(F.broadcast(drawn), "doc_id").select("toxic", "half", "text")
    drawn_sizes = [min(sizes[c], SAMPLE) for c in (0, 1)]
    lexicon = learn_lexicon(sample, drawn_sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = features_of(matcher, piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("toxic"), *map(pa.array, found.T)], names=["toxic", *(f"f{i}" for i in range(FEATURES))])

    rows = np.array(in_batches(sample, run, "toxic int, " + ", ".join(f"f{i} double" for i in range(FEATURES))).collect(), float)
    if len(set(rows[:, 0])) < 2 if len(rows) else True:
        return None
    return Model(lexicon, regress(rows[:, 1:], rows[:, 0]))


def scored(docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with score; carry: the columns to keep, if not all."""
    carry = docs.columns if carry is None else carry
    plain, names = numbered(docs)
    if model is None:
        return renamed(plain.select(*[names[docs.columns.index(c)] for c in carry], F.lit(0.0).alias("score")), carry, 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names[docs.columns.index(text)]
    kept = [names[docs.columns.index(c)] for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = Matcher(model.lexicon)
        for batch in batches:
            for part in pieces(batch, at):
                scores = [model.score(matcher.features(t)) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(scores, pa.float64())], names=[*kept, "score"])

    return renamed(in_batches(plain, run, plain.select(kept).schema.add("score", "double")), carry, 1)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, by a model fitted on the labels of rows that aren't held out."""
    model = fit(docs.filter(~held_out()), labels.filter(~held_out()))
    found = scored(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
