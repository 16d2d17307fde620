"""Byte-level BPE: encoding by a bounded-lookahead transducer, decoding by an incremental state machine.

A merge list fixes for every prefix of a piece one last token: the only token ending there that fits the last token of
the prefix before it. Two tokens fit if no merge crosses their border before both are finished, which the merges on the border's
two sides tell. So the transducer reads a piece byte by byte along the trie of all tokens, falls back to the longest suffix that begins a token
where the trie ends, and notes for each position its last token: of the tokens ending there, longest first, the one that fits. Short pieces of a
batch go through it side by side, one byte of each at a time; a longer one goes alone, in portions.

A token that goes on from what was read begins no further back than the trie is deep at that moment, `lookahead` bytes at most, which the merge list
tells. A border that the paths from all these positions share is stable: the tokens before it are emitted and forgotten, so memory stays the
same however long a piece is. The decoder keeps the bytes of a code point that has begun, and nothing else.

Defined results: null and empty texts have no tokens; strings of the file's added tokens in a text are those tokens. Every other
column is carried along, but for those with the name of an added one, which that replaces.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.arrow import in_batches, numbered, renamed
from quillspark.llm.text import pieces as slices

# The splitting pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Strings whose tokens a worker remembers, and their code points at most; when it has more, it forgets all and starts again.
REMEMBERED, LONG = 150_000, 48
#: Bytes of a piece that goes side by side with others, and such pieces at once.
SHORT, ABREAST = 64, 8192
#: Places for what is known of pairs of tokens, 8 bytes each; a pair takes the place of the one before it.
PAIRS = 1_000_003
NEVER = 1 << 40
#: Bytes that the transducer takes in before it looks for a stable border.
PORTION = 4096


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 letters for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def portions(data: bytes, most: int = PORTION) -> Iterator[bytes]:
    return (data[i : i + most] for i in range(0, len(data), most))


class Bpe:
    """A tokenizer file of the byte-level kind, as tables."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {to_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.many = 1 + max(self.bytes_of)  # a pair of ids is left * many + right; `many` itself stands for the beginning of a piece
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # a token's last merge: rank, left and right part
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (self.ids[to_bytes(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[left * self.many + right] = rank
            self.made.setdefault(self.ids[self.bytes_of[left] + self.bytes_of[right]], (rank, left, right))
        single = {self.ids[bytes([b])] for b in range(256) if bytes([b]) in self.ids}
        # a merge that its own parts never reach isn't a token that a text can have
        self.tokens = {b: i for b, i in self.ids.items() if i in single or (i in self.made and self.fit_inside(i))}
        self.size_of = {i: len(b) for b, i in self.tokens.items()}
        self.sizes = np.zeros(self.many, np.int64)
        self.sizes[list(self.size_of)] = list(self.size_of.values())
        self.lookahead = max(self.size_of.values())
        # the same tables for many pairs at once: sorted pairs with their ranks, and each token's last merge
        self.rank_keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.rank_keys.tolist()], np.int64)
        self.parts = np.full((self.many, 3), NEVER)
        self.parts[list(self.made)] = list(self.made.values())
        self.pairs = array("q", [-1]) * PAIRS  # at pair % PAIRS: 2 * pair, and 1 if it fits
        self.build_trie()
        self.split = regex.compile(PATTERN).findall
        #: The tokens of the stretches seen lately: of those that begin a text, and of those that follow a space.
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of a token while it's being made, and the rank at which each is used up."""
        found, until = [], NEVER
        while True:
            found.append((token, until))
            if token not in self.made:
                return found
            until, token = self.made[token][0], self.made[token][side]

    def crossed(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether a merge crosses the border of two tokens, of a rank under before; of equal merges the left one comes first."""
        ends = self.edge(right, 1)
        for x, x_until in self.edge(left, 2):
            for y, y_until in ends:
                r = self.rank.get(x * self.many + y)
                if r is not None and r < x_until and r <= y_until and r < before:
                    return True
        return False

    def fit(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs of tokens can stand side by side."""
        found = np.frombuffer(self.pairs, np.int64)[pairs % PAIRS]
        other = found >> 1 != pairs
        if other.any():
            new, where = np.unique(pairs[other], return_inverse=True)
            known = 2 * new + ((new // self.many == self.many) | ~self.crossed_each(new // self.many, new % self.many))
            np.frombuffer(self.pairs, np.int64)[new % PAIRS] = known
            found[other] = known[where]
        return (found & 1).astype(bool)

    def crossed_each(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """crossed() for many pairs."""
        crossed = np.zeros(len(left), bool)
        x, x_until, at = left.copy(), np.full(len(left), NEVER), np.flatnonzero(left < self.many)
        while len(at):
            y, y_until, open_ = right.copy(), np.full(len(left), NEVER), at
            while len(open_):
                key = x[open_] * self.many + y[open_]
                spot = np.minimum(np.searchsorted(self.rank_keys, key), len(self.rank_keys) - 1)
                r = np.where(self.rank_keys[spot] == key, self.ranks[spot], NEVER)
                crossed[open_] |= (r < x_until[open_]) & (r <= y_until[open_])
                open_ = open_[~crossed[open_] & (self.parts[y[open_], 0] < NEVER)]
                y_until[open_], y[open_] = self.parts[y[open_], 0], self.parts[y[open_], 1]
            at = at[~crossed[at] & (self.parts[x[at], 0] < NEVER)]
            x_until[at], x[at] = self.parts[x[at], 0], self.parts[x[at], 2]
        return crossed

    def fit_one(self, pair: int) -> int:
        """2 * pair, and 1 if its tokens can stand side by side; goes to its place."""
        left, right = divmod(pair, self.many)
        known = self.pairs[pair % PAIRS] = 2 * pair + (left == self.many or not self.crossed(left, right))
        return known

    def fit_inside(self, token: int) -> bool:
        """Whether the parts of a token come together by its own merge: no other merge crosses their border earlier."""
        own, left, right = self.made[token]
        return not self.crossed(left, right, own)

    def build_trie(self) -> None:
        """Nodes of the trie by number; a move is keyed by node * 256 + byte. The root is 0."""
        self.moves: dict[int, int] = {}
        self.depth, self.token_at, above = [0], [-1], [(0, 0)]
        for token, i in self.tokens.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.moves.setdefault(key, len(self.depth))
                if node == len(self.depth):
                    self.depth.append(self.depth[key >> 8] + 1)
                    self.token_at.append(-1)
                    above.append((key >> 8, byte))
            self.token_at[node] = i
        #: The node of the longest suffix that begins a token; the node of the longest token that ends here; that of the next shorter one.
        suffix, ending, shorter = ([0] * len(above) for _ in range(3))
        for node in sorted(range(1, len(above)), key=self.depth.__getitem__):
            parent, byte = above[node]
            if parent:
                back = suffix[parent]
                while back and back << 8 | byte not in self.moves:
                    back = suffix[back]
                suffix[node] = self.moves.get(back << 8 | byte, 0)
            shorter[node] = ending[suffix[node]]
            ending[node] = node if self.token_at[node] >= 0 else shorter[node]
        # arrays, which NumPy reads in place
        self.suffix, self.ending, self.shorter, self.depth, self.token_at = (array("i", x) for x in (suffix, ending, shorter, self.depth, self.token_at))
        keys = sorted(self.moves)
        self.keys, self.targets = array("q", keys), array("i", map(self.moves.__getitem__, keys))
        del self.moves

    def next(self, node: int, byte: int) -> int:
        """The next node: along the trie, or from the longest suffix that has the byte."""
        keys = self.keys
        while True:
            key = node << 8 | byte
            at = bisect_left(keys, key)
            if at < len(keys) and keys[at] == key:
                return self.targets[at]
            if not node:
                return 0
            node = self.suffix[node]

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """next() for many nodes."""
        all_keys, suffix = np.frombuffer(self.keys, np.int64), np.frombuffer(self.suffix, np.int32)
        found, open_ = np.zeros(len(node), np.int32), np.arange(len(node))
        while len(open_):
            keys = node.astype(np.int64) << 8 | byte
            at = np.minimum(np.searchsorted(all_keys, keys), len(all_keys) - 1)
            hit = all_keys[at] == keys
            found[open_[hit]] = np.frombuffer(self.targets, np.int32)[at[hit]]
            left = ~hit & (node > 0)
            open_, byte, node = open_[left], byte[left], suffix[node[left]]
        return found

    def last_tokens(self, node: np.ndarray, last: np.ndarray, end: int) -> np.ndarray:
        """The token that ends at `end`, for each row: the longest that fits the last one before it. last: of each row, the last token at every position."""
        ending, shorter, depth, token_at = (np.frombuffer(x, np.int32) for x in (self.ending, self.shorter, self.depth, self.token_at))
        at, found, open_ = ending[node], np.empty(len(node), np.int32), np.arange(len(node))
        while len(open_):
            size, token = depth[at], token_at[at]
            fits = size <= end  # not across the first position
            fits[fits] = self.fit(last[open_[fits], end - size[fits]].astype(np.int64) * self.many + token[fits])
            found[open_[fits]] = token[fits]
            open_, at = open_[~fits], shorter[at[~fits]]
        return found

    def abreast(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of short pieces as 32-bit integers: one byte of each at a time."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        begin, data = (np.cumsum(sizes) - sizes)[order], np.frombuffer(b"".join(pieces), np.uint8)
        sizes = sizes[order]
        last = np.empty((len(pieces), sizes[0] + 1), np.int32)
        last[:, 0] = self.many
        node = np.zeros(len(pieces), np.int32)
        for end in range(1, sizes[0] + 1):
            n = np.searchsorted(-sizes, -end, "right")  # so many have this many bytes
            node = self.step(node[:n], data[begin[:n] + end - 1])
            last[:n, end] = self.last_tokens(node, last, end)
        # back along the tokens, from the ends of all pieces
        tokens, rows, end = [], np.arange(len(pieces)), sizes.copy()
        while len(rows):
            token = last[rows, end]
            tokens.append((rows, token))
            end = end - self.sizes[token]
            rows, end = rows[end > 0], end[end > 0]
        row, token = (np.concatenate(x) for x in zip(*tokens[::-1]))
        by_row = np.argsort(row, kind="stable")
        raw, past = token[by_row].tobytes(), np.cumsum(np.bincount(row, minlength=len(pieces))) * 4
        found: list[bytes] = [b""] * len(pieces)
        for i, a, b in zip(order.tolist(), [0, *past.tolist()], past.tolist()):
            found[i] = raw[a:b]
        return found

    def alone(self, piece: bytes) -> bytes:
        """The ids of one piece, through a transducer of its own."""
        transducer = Transducer(self)
        found = array("i")
        for portion in portions(piece):
            found.extend(transducer.feed(portion))
        found.extend(transducer.finish())
        return found.tobytes()

    def learn(self, stretches: set[str], known: dict[str, bytes], before: str) -> None:
        """Tokens of all stretches that aren't known, each with the text before it."""
        new = stretches - known.keys()
        whole = [s for s in new if s.isascii() and s.isalpha()]  # one piece each
        known.update(zip(whole, self.ids_of([(before + s).encode() for s in whole])))
        new.difference_update(whole)
        cut = [self.split(before + s) for s in new]
        pieces = list({p for c in cut for p in c})
        of = dict(zip(pieces, self.ids_of([p.encode() for p in pieces])))
        known.update((s, b"".join([of[p] for p in c])) for s, c in zip(new, cut))

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces as 32-bit integers: short ones side by side, longer ones alone."""
        found: list[bytes] = []
        for i in range(0, len(pieces), ABREAST):
            some = pieces[i : i + ABREAST]
            if max(map(len, some)) <= SHORT:
                found += self.abreast(some)
                continue
            short = iter(self.abreast([b for b in some if len(b) <= SHORT]))
            found += [next(short) if len(b) <= SHORT else self.alone(b) for b in some]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as 32-bit integers."""
        cut = [self.plain_parts(text) for text in texts]
        at_start, after_space = self.known
        for known in self.known:
            if len(known) > REMEMBERED:
                known.clear()
        firsts, rests = {part[0] for parts in cut for part, _ in parts}, {s for parts in cut for part, _ in parts for s in part[1:]}
        self.learn(firsts, at_start, "")
        self.learn(rests, after_space, " ")
        get = after_space.__getitem__
        done = [b"".join([x for part, token in parts for x in (at_start[part[0]], *map(get, part[1:]), token)]) for parts in cut]
        for found, known in ((firsts, at_start), (rests, after_space)):
            for s in [s for s in found if len(s) > LONG]:
                del known[s]
        return done

    def plain_parts(self, text: str) -> list[tuple[list[str], bytes]]:
        """What stands between added tokens, in stretches, each part with the added token after it."""
        if not self.added or not self.split_added.search(text):
            return [(stretches(text), b"")]
        out, at = [], 0
        for found in self.split_added.finditer(text):
            out.append((stretches(text[at : found.start()]), np.int32(self.added[found[0]]).tobytes()))
            at = found.end()
        return [*out, (stretches(text[at:]), b"")]


def stretches(text: str) -> list[str]:
    """The text cut at every space that a black character follows; a piece always ends before such a space."""
    return _SPACE.split(text) if _UNSAFE.search(text) else text.split(" ")


_UNSAFE, _SPACE = re.compile(r" (?:\s|\Z)"), re.compile(r" (?=\S)")


class Transducer:
    """The bytes of one piece to its ids, in any portions; keeps what isn't stable yet."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.node = bpe, 0
        self.last = [bpe.many]  # the last token at each position that is kept

    def feed(self, portion: bytes) -> list[int]:
        """Takes in a portion; gives the ids that are stable."""
        bpe, node, last = self.bpe, self.node, self.last
        pairs, many = bpe.pairs, bpe.many
        end = len(last)
        for byte in portion:
            node = bpe.next(node, byte)
            at = bpe.ending[node]
            while True:
                size, token = bpe.depth[at], bpe.token_at[at]
                if size <= end:  # not across the first position that is kept
                    pair = last[end - size] * many + token
                    known = pairs[pair % PAIRS]
                    if (known if known >> 1 == pair else bpe.fit_one(pair)) & 1:
                        break
                at = bpe.shorter[at]
            last.append(token)
            end += 1
        self.node = node
        return self.settle()

    def settle(self) -> list[int]:
        """The ids before the last border that is on the paths from all positions where tokens can still begin."""
        last, size_of, end = self.last, self.bpe.size_of, len(self.last) - 1
        open_ = set(range(end - self.bpe.depth[self.node], end + 1))
        while len(open_) > 1:
            i = max(open_)
            open_.remove(i)
            open_.add(i - size_of[last[i]])
        stable = open_.pop()
        found = self.path(stable)
        self.last = last[stable:]
        return found

    def finish(self) -> list[int]:
        return self.path(len(self.last) - 1)

    def path(self, end: int) -> list[int]:
        found, last, size_of = [], self.last, self.bpe.size_of
        while end > 0:
            found.append(token := last[end])
            end -= size_of[token]
        return found[::-1]



class Decoder:
    """Token ids to text, in any portions."""

    def __init__(self, bpe: Bpe) -> None:
        self.bytes_of = bpe.bytes_of.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, ids)), final)


def decode(bpe: Bpe, ids: np.ndarray, portion: int = 4096) -> str:
    state = Decoder(bpe)
    return "".join([*(state.feed(ids[i : i + portion].tolist()) for i in range(0, len(ids), portion)), state.feed((), True)])


@lru_cache(2)
def loaded(raw: bytes) -> Bpe:
    return Bpe(raw)


def tokenized(docs: DataFrame, tokenizer: str | Path, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with ids, the tokens of each text, and decoded, the text that they give.

    tokenizer: path of a byte-level BPE file, read by the driver; carry: the columns to keep, if not all.
    """
    carry = docs.columns if carry is None else carry
    raw = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    plain, names = numbered(docs)
    at = names[docs.columns.index(text)]
    kept = [names[docs.columns.index(c)] for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(raw.value)
        for batch in batches:
            for part in slices(batch, at):
                encoded = bpe.encode([x or "" for x in part.column(at).to_pylist()])
                edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in encoded])]).astype(np.int32)
                values = np.frombuffer(b"".join(encoded), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(values))
                back = pa.array([decode(bpe, values[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), ids, back], names=[*kept, "ids", "decoded"])

    schema = plain.select(kept).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return renamed(in_batches(plain, run, schema), carry, 2)


def token_report(docs: DataFrame, tokenizer: str | Path) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs."""
    found = tokenized(docs.select("doc_id", "text"), tokenizer, carry=["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
