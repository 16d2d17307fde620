"""Secrets in texts: plain patterns, and credentials whose parts stand apart.

1. Tasks find in every text the base spans (assignments, access keys, long hexadecimal runs), and weak candidates, which say nothing by themselves:
   short values of secrets, opaque tokens, account names and endpoints.
2. The parts of a text are joined by intervals within scopes: two parts are near if no blank line divides them and at most `reach` code points lie between
   them. Running maxima of ends and minima of starts, over the parts of a scope in order, tell for every part whether a part of each role is near: no pairs are made.
3. A weak candidate is reported if complementary parts are near: a short or opaque secret with an access key, or with an account and an endpoint; an account
   with a base secret, or with a weak one and an endpoint; an endpoint with an identifier and a secret. Base spans stay in any case.

Only texts with weak candidates are shuffled, and of these only the parts.

Defined results: null and empty texts have no spans. Rows that share an id, or have none, are different texts. Positions are code points; ends are exclusive. Other columns
are carried along, but for `found`, which the new one replaces. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.arrow import in_batches, numbered, renamed
from quillspark.llm.terms import spans
from quillspark.llm.text import content, pieces
from quillspark.sources.scratch import written

# The patterns of the base spans.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = b"0123456789abcdef"
VALUE, KEY, RUN = 8, 16, 32
#: Weak candidates: a short value, names of accounts and endpoints, and opaque tokens, which have a capital, a small letter and a digit.
LEAST, OPAQUE = 4, 20
ACCOUNT = re.compile(rb"(user|username|login|account|client_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]+)", re.I)
PLACE = re.compile(rb"(host|hostname|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.:/-]+)|[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\x00-\x20\"'<>`]+", re.I)
BLANK = re.compile(rb"\n[\x20\t\r]*\n")
#: In the order in which kinds with the same start are listed, and in which weak candidates give way to what they overlap.
BASE, WEAK = ("assign", "access", "hex"), ("short", "account", "endpoint", "opaque")
KINDS = BASE + WEAK
#: Code points between two parts of a credential.
REACH = 300
PARTS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("scope", "integer"))
FOUND = "array<struct<kind:string,start:int,end:int>>"


def byte_class(letters: bytes) -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[list(letters)] = True
    return inside


_HEX, _TOKEN = byte_class(HEX), byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_CLASSES = [byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_class(b"abcdefghijklmnopqrstuvwxyz"), byte_class(b"0123456789")]
_NAMES = {"assign": (b"passw", b"secret", b"token", b"key"), "account": (b"user", b"login", b"account", b"client", b"key"), "endpoint": (b"host", b"server", b"endpoint", b"://")}


def long_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """The maximal runs of bytes of a class that have `least` bytes, by text, from the text's first byte."""
    starts, ends, of = spans(inside[data], offsets)
    long = np.flatnonzero(ends - starts >= least)
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b, i in zip(starts[long].tolist(), ends[long].tolist(), of[long].tolist()):
        found.setdefault(i, []).append((a - int(offsets[i]), b - int(offsets[i])))
    return found


def opaque(text: bytes, a: int, b: int) -> bool:
    token = np.frombuffer(text, np.uint8)[a:b]
    return all(kind[token].any() for kind in _CLASSES)


def candidates(text: bytes, hexes: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Spans of all kinds in bytes; those of a kind are in order and do not overlap."""
    found: dict[str, list[tuple[int, int]]] = {"hex": hexes} if hexes else {}
    lower = text.lower()
    if any(name in lower for name in _NAMES["assign"]):
        for m in ASSIGN.finditer(text):
            size = m.end(2) - m.start(2)
            if size >= LEAST:
                found.setdefault("assign" if size >= VALUE else "short", []).append(m.span())
    if b"AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= KEY]
    if any(name in lower for name in _NAMES["account"]):
        found["account"] = [m.span() for m in ACCOUNT.finditer(text)]
    if any(name in lower for name in _NAMES["endpoint"]):
        found["endpoint"] = [m.span() for m in PLACE.finditer(text)]
    found["opaque"] = [(a, b) for a, b in tokens if opaque(text, a, b)]
    return {kind: found[kind] for kind in KINDS if found.get(kind)}


def without_overlaps(found: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Base spans, and weak ones that no span of a kind before theirs overlaps; by start, then kind."""
    kept: dict[str, list[tuple[int, int]]] = {}
    for kind, own in found.items():
        free = own
        if kind in WEAK:
            for other in kept.values():
                starts = [a for a, _ in other]
                free = [(a, b) for a, b in free if not ((i := bisect_right(starts, b - 1)) and other[i - 1][1] > a)]
        kept[kind] = free
    return sorted(((kind, a, b) for kind, own in kept.items() for a, b in own), key=lambda x: (x[1], KINDS.index(x[0])))


def parts_of(text: bytes, hexes: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> list[dict]:
    """The parts of a text in code points, with the number of blank lines before them."""
    found = without_overlaps(candidates(text, hexes, tokens))
    if not found:
        return []
    at = np.array([(a, b) for _, a, b in found])
    scope = np.searchsorted([m.start() for m in BLANK.finditer(text)], at[:, 0], "right")
    if not text.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        at = points[at]
    return [{"kind": kind, "start": a, "end": b, "scope": s} for (kind, _, _), (a, b), s in zip(found, at.tolist(), scope.tolist())]


def find_parts(at: str, kept: list[str], parts_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, at):
                data, offsets = content(piece.column(at))
                hexes, tokens = long_runs(data, offsets, _HEX, RUN), long_runs(data, offsets, _TOKEN, OPAQUE)
                raw, edges = data.tobytes(), offsets.tolist()
                parts = [parts_of(raw[a:b], hexes.get(i, []), tokens.get(i, [])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
                yield pa.RecordBatch.from_arrays([*map(piece.column, kept), pa.array(parts, parts_type)], names=[*kept, "parts"])

    return run


def near(role: Column, reach: int) -> Column:
    """Whether a part of a role is near, in the same scope of the same text."""
    scope = Window.partitionBy("row", "part.scope")
    before = F.max(F.when(role, F.col("part.end"))).over(scope.orderBy("part.start").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(role, F.col("part.start"))).over(scope.orderBy(F.desc("part.start")).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.col("part.start") - before <= reach, F.lit(False)) | F.coalesce(after - F.col("part.end") <= reach, F.lit(False))


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """row and part of the parts (row, part) that are base spans, or weak candidates with their complement near."""
    kind = F.col("part.kind")
    roles = {"key": kind == "access", "identifier": kind.isin("access", "account"), "base": kind.isin("assign", "hex"), "secret": kind.isin("assign", "hex", "short", "opaque"), "place": kind == "endpoint"}
    told = parts.select("row", "part", *[near(role, reach).alias(name) for name, role in roles.items()])
    secret = F.col("key") | (F.col("identifier") & F.col("place"))
    account = F.col("base") | (F.col("secret") & F.col("place"))
    place = F.col("identifier") & F.col("secret")
    return told.filter(kind.isin(*BASE) | F.when(kind.isin("short", "opaque"), secret).when(kind == "account", account).otherwise(place)).select("row", "part")


def in_order(parts: Column) -> Column:
    """Parts by start, then by kind in the order of KINDS."""
    order = lambda p: F.struct(p["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), p["kind"]).alias("order"), p["kind"].alias("kind"), p["end"].alias("end"))
    return F.transform(F.array_sort(F.transform(parts, order)), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))


def secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """docs with found: their secrets as (kind, start, end); carry: the columns to keep, if not all."""
    carry = docs.columns if carry is None else carry
    plain, names = numbered(docs)
    kept = [names[docs.columns.index(c)] for c in carry]
    at = names[docs.columns.index(text)]
    schema = T.StructType([*plain.select(*kept).schema.fields, T.StructField("parts", PARTS)])
    parts_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())]))
    parts = written(in_batches(plain, find_parts(at, kept, parts_type), schema).withColumn("row", F.monotonically_increasing_id()), "secrets-parts")
    weak = F.exists("parts", lambda p: p["kind"].isin(*WEAK))
    simple = parts.filter(~weak).select(*kept, in_order(F.col("parts")).alias("found"))
    reported = linked(parts.filter(weak).select("row", F.explode("parts").alias("part")), reach).groupBy("row").agg(F.collect_list("part").alias("reported"))  # a text's
    joined = parts.filter(weak).join(reported, "row", "left").select(*kept, in_order(F.coalesce("reported", F.array().cast(PARTS))).alias("found"))
    return renamed(simple.unionByName(joined), carry, 1)


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked (spans that only their complement brought in)."""
    found = secrets(docs.select("doc_id", "text"), carry=["doc_id"])
    of = lambda *kinds: F.filter("found", lambda p: p["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(as_text(of(*BASE)), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"), F.size(of(*WEAK)).cast("long").alias("n_linked"))


SQL = r"""
WITH patterns(kind, pattern) AS (VALUES
  ('a', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 'AKIA[A-Z0-9]+'), ('hex', '[0-9a-f]+'), ('opaque', '[A-Za-z0-9+/_-]+'), ('blank', '\n[\x20\t\r]*\n'),
  ('account', '([uU][sS][eE][rR]|[uU][sS][eE][rR][nN][aA][mM][eE]|[lL][oO][gG][iI][nN]|[aA][cC][cC][oO][uU][nN][tT]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[kK][eE][yY]_?[iI][dD])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9_.@+-]+)'),
  ('endpoint', '([hH][oO][sS][tT]|[hH][oO][sS][tT][nN][aA][mM][eE]|[sS][eE][rR][vV][eE][rR]|[eE][nN][dD][pP][oO][iI][nN][tT])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9_.:/-]+)|[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\x00-\x20"''<>`]+')),
places AS (
  SELECT doc_id, kind, i, m, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS a, sum(length(gap) + length(m)) OVER w AS b FROM (
    SELECT doc_id, kind, pattern, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM (
      SELECT doc_id, kind, pattern, regexp_extract_all(text, pattern) AS ms, regexp_split_to_array(text, pattern) AS gaps FROM documents, patterns))
  WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING)),
told AS (
  SELECT doc_id, CASE WHEN kind <> 'a' THEN kind WHEN length(regexp_extract(m, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 8 THEN 'assign' WHEN length(regexp_extract(m, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 4 THEN 'short' END AS kind, a, b FROM places
  WHERE CASE kind WHEN 'access' THEN length(m) >= 16 WHEN 'hex' THEN length(m) >= 32
    WHEN 'opaque' THEN length(m) >= 20 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]') ELSE true END),
base AS (SELECT *, ['assign', 'access', 'hex'].list_position(kind) AS o FROM told WHERE kind IN ('assign', 'access', 'hex')),
k1 AS (SELECT * FROM base UNION ALL SELECT *, 4 FROM told t WHERE kind = 'short' AND NOT EXISTS (SELECT 1 FROM base k WHERE k.doc_id = t.doc_id AND k.a < t.b AND k.b > t.a)),
k2 AS (SELECT * FROM k1 UNION ALL SELECT *, 5 FROM told t WHERE kind = 'account' AND NOT EXISTS (SELECT 1 FROM k1 k WHERE k.doc_id = t.doc_id AND k.a < t.b AND k.b > t.a)),
k3 AS (SELECT * FROM k2 UNION ALL SELECT *, 6 FROM told t WHERE kind = 'endpoint' AND NOT EXISTS (SELECT 1 FROM k2 k WHERE k.doc_id = t.doc_id AND k.a < t.b AND k.b > t.a)),
k4 AS (SELECT * FROM k3 UNION ALL SELECT *, 7 FROM told t WHERE kind = 'opaque' AND NOT EXISTS (SELECT 1 FROM k3 k WHERE k.doc_id = t.doc_id AND k.a < t.b AND k.b > t.a)),
parts AS (SELECT *, (SELECT count(*) FROM told x WHERE x.doc_id = k.doc_id AND x.kind = 'blank' AND x.a <= k.a) AS scope FROM k4 k),
near AS (
  SELECT p.doc_id, p.kind, p.a, p.b, p.o, bool_or(q.kind = 'access') AS key, bool_or(q.kind IN ('access', 'account')) AS identifier, bool_or(q.kind IN ('assign', 'hex')) AS strong,
    bool_or(q.kind IN ('assign', 'hex', 'short', 'opaque')) AS secret, bool_or(q.kind = 'endpoint') AS place
  FROM parts p JOIN parts q ON p.doc_id = q.doc_id AND p.scope = q.scope AND ((q.a >= p.a AND q.a - p.b <= 300) OR (q.a <= p.a AND p.a - q.b <= 300)) GROUP BY ALL),
kept AS (
  SELECT * FROM near WHERE o <= 3 OR CASE kind WHEN 'account' THEN strong OR (secret AND place) WHEN 'endpoint' THEN identifier AND secret ELSE key OR (identifier AND place) END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, o) FILTER (o <= 3), '')) AS base_sha256, coalesce(string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, o) FILTER (o IS NOT NULL), '') AS spans, count(*) FILTER (o > 3) AS n_linked
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""
