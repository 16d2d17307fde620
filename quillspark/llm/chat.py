"""Chat transcripts to canonical turns, by a hidden Markov model.

The lines of a transcript are observations; the states are a role and whether the line begins a turn or continues it. What is observed of a
line is its speaker marker (`User:`, `### Assistant`, `<|im_start|>system`, `Q:`, `> bot` ...), its length, its ending, how it begins and whether a
blank line precedes it. Viterbi finds the likeliest sequence of roles; runs of lines become turns, markers are taken off, and turns are
rendered in one canonical form. The tables of the model are counts from labelled transcripts (smoothed), summed in Spark; without any, a
prior that trusts the markers is used.

Defined results: a null or empty transcript has no turns and the empty rendering; blank lines belong to the turn they stand in, and
are dropped at its ends. Other columns are carried along, but for those with the name of an added one, which that replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.arrow import in_batches, numbered, renamed
from quillspark.llm.text import pieces

#: The last one stands for every other role, a null one too.
ROLES = ["system", "user", "assistant", "tool"]
# What transcripts call the roles.
NAMES = {
    "system": ["system", "sys", "instruction", "instructions"],
    "user": ["user", "human", "you", "customer", "client", "question", "q", "prompt", "me"],
    "assistant": ["assistant", "ai", "bot", "chatbot", "agent", "answer", "a", "gpt", "model", "response"],
    "tool": ["tool", "function", "developer", "observation", "result"],
}
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_NAME = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:<\|im_start\|>\s*({_NAME})\b\s*|<\|?({_NAME})\|?>\s*|\[({_NAME})\]\s*:?\s*|#{{1,6}}\s*({_NAME})\s*:?(?:\s+|$)|(?:[>*_]+\s*)?({_NAME})\s*[*_]*\s*:[*_]*\s*)", re.I)
_END = re.compile(r"\s*<\|(?:im_end|end|eot_id)\|>\s*$")
#: Turns of one transcript at most when it is made from a table of turns; a longer conversation makes several.
PART = 1000
STATES = 2 * len(ROLES)  # state 2 * role: begins a turn; 2 * role + 1: continues it
FEATURES = {"marker": 1 + len(ROLES), "length": 5, "ending": 4, "start": 4, "blank": 2}


def marker(line: str) -> tuple[int, str]:
    """The role that a line's marker names (0: none, else 1 + role) and the line without it."""
    found = _MARKER.match(line)
    if not found:
        return 0, line
    name = next(g for g in found.groups() if g)
    return 1 + ROLES.index(_ROLE_OF[name.lower()]), line[found.end() :]


def observe(lines: list[str]) -> np.ndarray:
    """A row of feature values for each line."""
    rows, blank = [], 1
    for line in lines:
        kind, rest = marker(line)
        rest = rest.strip()
        length = 0 if not rest else 1 if len(rest) < 40 else 2 if len(rest) < 120 else 3 if len(rest) < 400 else 4
        ending = 1 if rest.endswith("?") else 2 if rest.endswith((".", "!", "…")) else 3 if rest.endswith((":", ",", ";")) else 0
        start = 0 if not rest else 1 if rest[0].isupper() else 2 if rest[0] in "-*•0123456789`#|" else 3
        rows.append((kind, length, ending, start, blank))
        blank = int(not rest)
    return np.array(rows, int).reshape(-1, len(FEATURES))


@dataclass
class Model:
    begin: np.ndarray  # log probabilities of the first state
    move: np.ndarray
    emit: list[np.ndarray]  # for each feature: states x values

    def roles(self, lines: list[str]) -> list[int]:
        """The likeliest state of each line, by Viterbi."""
        seen = observe(lines)
        if not len(seen):
            return []
        scores = sum(table[:, seen[:, i]] for i, table in enumerate(self.emit)).T
        best, back = self.begin + scores[0], []
        for row in scores[1:]:
            through = best[:, None] + self.move
            came = through.argmax(0)
            back.append(came)
            best = through[came, np.arange(STATES)] + row
        states = [int(best.argmax())]
        for came in reversed(back):
            states.append(int(came[states[-1]]))
        return states[::-1]


def tables(counts: dict[tuple[str, int, int], float]) -> Model:
    """Counts (what, state, value) to smoothed log probabilities, over a prior of a few imagined lines."""
    begin, move = np.full(STATES, 0.01), np.full((STATES, STATES), 0.05)
    begin[::2] += [1, 3, 0.5, 0.1]
    for role in range(len(ROLES)):
        for state in (2 * role, 2 * role + 1):
            move[state, 2 * role + 1] += 3
            move[state, [2 * r for r in range(len(ROLES)) if r != role and r]] += 1
    # a line can't continue a turn of another role
    forbidden = np.array([[b % 2 and a // 2 != b // 2 for b in range(STATES)] for a in range(STATES)])
    emit = [np.full((STATES, n), 0.5) for n in FEATURES.values()]
    for role in range(len(ROLES)):
        emit[0][2 * role, 0] += 2
        emit[0][2 * role, 1 + role] += 8
        emit[0][2 * role + 1, 0] += 10
    for (what, state, value), n in counts.items():
        if what == "begin":
            begin[value] += n
        elif what == "move":
            move[state, value] += n
        else:
            emit[list(FEATURES).index(what)][state, value] += n
    begin[1::2] = 1e-9
    with np.errstate(divide="ignore"):
        log_move = np.where(forbidden, -np.inf, np.log(move / np.where(forbidden, 0, move).sum(1, keepdims=True)))
    return Model(np.log(begin / begin.sum()), log_move, [np.log(t / t.sum(1, keepdims=True)) for t in emit])


def turns(model: Model, transcript: str | None) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    lines = (transcript or "").replace("\r\n", "\n").split("\n")
    if lines == [""]:
        return []
    found: list[tuple[str, list[str], bool]] = []
    for line, state in zip(lines, model.roles(lines)):
        role = ROLES[state // 2]
        kind, rest = marker(line)
        own = rest if kind == 1 + state // 2 else line
        if state % 2 == 0 or not found:
            found.append((role, [own], kind > 0))
        else:
            found[-1][1].append(own)
    done = [(role, _END.sub("", "\n".join(body)).strip("\n"), marked) for role, body, marked in found]
    return [(role, text if text.strip() else "") for role, text, marked in done if marked or text.strip()]  # a speaker who says nothing has a turn


def render(found: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in found)


def count_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transcripts with the state of each line, to counts."""
    for batch in batches:
        out: dict[tuple[str, int, int], int] = {}

        def add(what: str, state: int, value: int) -> None:
            out[what, state, value] = out.get((what, state, value), 0) + 1

        for text, states in zip(batch.column("transcript").to_pylist(), batch.column("states").to_pylist()):
            if not states:
                continue
            add("begin", 0, states[0])
            for a, b in zip(states, states[1:]):
                add("move", a, b)
            for state, row in zip(states, observe(text.split("\n")).tolist()):
                for what, value in zip(FEATURES, row):
                    add(what, state, value)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int32()), pa.array([k[2] for k in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["what", "state", "value", "n"])


def fit(labelled: DataFrame) -> Model:
    """A model from (transcript, states): one state for each line. The counts have as many rows as the model has entries."""
    counts = in_batches(labelled.select("transcript", "states"), count_tables, "what string, state int, value int, n long")
    rows = counts.groupBy("what", "state", "value").agg(F.sum("n").alias("n")).collect()
    return tables({(r.what, r.state, r.value): r.n for r in rows})


def parsed(transcripts: DataFrame, model: Model, text: str = "transcript") -> DataFrame:
    """transcripts with turns (role, text) and rendered, in place of the transcript."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)
    carry = [c for c in transcripts.columns if c != text]
    plain, names = numbered(transcripts)
    at = names.pop(transcripts.columns.index(text))
    plain = plain.withColumnRenamed(at, "transcript")
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "transcript"):
                found = [turns(shared.value, t) for t in part.column("transcript").to_pylist()]
                rows = pa.array([[{"role": r, "text": t} for r, t in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([*map(part.column, names), rows, pa.array(map(render, found), pa.string())], names=[*names, "turns", "rendered"])

    schema = plain.select(names).schema.add("turns", T.ArrayType(T.StructType().add("role", "string").add("text", "string"))).add("rendered", "string")
    return renamed(in_batches(plain, run, schema), carry, 2)


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as transcripts (conv_id, part, transcript, states, roles): each turn's lines, the first with a marker in one of several styles, or with none in one turn of four.

    Every row is a turn: a role that isn't one of ROLES, or null, is the last of them, a null text is empty, and rows without a turn come first. A conversation of more than PART turns makes several.
    Equal rows count once. A row without a conversation is one of its own, so no group gathers all of them.
    """
    names = F.element_at(F.create_map(*[F.lit(x) for role, found in NAMES.items() for x in (role, F.array(*map(F.lit, found[:2])))]), F.col("role"))
    style = F.pmod(F.xxhash64("conv_id", F.lit("style")), F.lit(4))
    name = F.get(names, F.pmod(F.xxhash64("conv_id", F.lit("name")), F.lit(2)).cast("int"))
    shown = F.when(style == 0, F.concat(F.initcap(name), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), F.initcap(name), F.lit(" "))).when(style == 2, F.concat(F.lit("["), name, F.lit("] "))).otherwise(F.concat(F.lit("<|im_start|>"), name, F.lit(" ")))
    hidden = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    known = F.coalesce(F.col("role").isin(ROLES), F.lit(False))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(known, F.col("role")).otherwise(ROLES[-1]).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("line", F.when(hidden, F.col("text")).otherwise(F.concat(shown, F.col("text"))))
    alone = F.pmod(F.xxhash64("text", "turn", "role"), F.lit(1 << 40))
    rows = rows.withColumn("part", F.when(F.col("conv_id").isNull(), alone).otherwise(F.floor(F.coalesce("turn", F.lit(0)) / PART)))
    role = (F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1).cast("int")
    rows = rows.withColumn("states", F.transform(F.split("line", "\n", -1), lambda line, i: 2 * role + F.when(i == 0, 0).otherwise(1)))
    ordered = F.array_sort(F.collect_set(F.struct("turn", "line", "states", "role")))
    by = rows.groupBy("conv_id", "part").agg(ordered.alias("rows"))
    return by.select("conv_id", "part", F.array_join("rows.line", "\n").alias("transcript"), F.flatten("rows.states").alias("states"), F.col("rows.role").alias("roles"))


def held_out(key: str = "conv_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chat_report(conversations: DataFrame) -> DataFrame:
    """conv_id, part, held_out, n_turns, n_found, same_roles and rendered of every conversation, by a model fitted on those that aren't held out."""
    made = transcripts(conversations)
    model = fit(made.filter(~held_out()))
    found = parsed(made.select("conv_id", "part", "roles", "transcript"), model)
    return found.select("conv_id", "part", held_out().alias("held_out"), F.size("roles").cast("long").alias("n_turns"), F.size("turns").cast("long").alias("n_found"), (F.col("roles") == F.col("turns.role")).alias("same_roles"), "rendered")
