"""Near-duplicate groups by word shingles: fast similarity sketches, banding, exact verification, components.

1. Each text becomes its set of k-word shingles (64-bit hashes), a 128-bit digest of that set and a sketch of COORDINATES values.
   The sketch hashes all shingles into bins, round after round with new hashes, until every bin is filled; after COORDINATES
   such rounds each bin that is left takes the least hash of a round of its own. So every coordinate fills, whatever the set's size.
2. Texts with equal sets are one class, and go on as the smallest id among them.
3. BANDS bands of ROWS coordinates are bucket keys. At a similarity of 0.85 a pair shares no bucket with a chance of 6e-11 (0.8: 5e-8).
4. In each bucket about HUBS members (hubs) are held against all others on full sets. Members that are then still in different components are
   held against each other in further rounds, with more hubs at a time, until every pair of a bucket is either in one
   component or has been compared. No bucket is capped, and pairs within a component are never listed.
5. Components are found by passing least ids along the confirmed links.

Defined results: texts without words (or null) have no shingles and are linked with nothing; texts of fewer than k words have their whole
word sequence as their only shingle; rows that share an id are one document; a row with a null id is linked with nothing, has a null component
and is kept; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrow import in_batches, numbered
from quillspark.sources.scratch import discard, written
from quillspark.llm.text import LOWER, SEQUENCE_BASE, binaries, content, mix, pieces, span_hashes, window_starts, word_hashes, word_spans

COORDINATES, BANDS, ROWS = 128, 32, 4
#: Partners of one member that are compared in one group; more are dealt to several groups.
GROUP = 512
#: Members of a bucket that are held against all others at once in the first round; 16 times as many in each further one, up to MOST_HUBS.
HUBS = 16
#: Hubs of a bucket in one round at most, so an id's list of hubs has at most BANDS times as many; what is left waits for further rounds.
MOST_HUBS = 4096
#: Rows of so many bytes together are broadcast; larger tables are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_SEEDS = np.random.default_rng(7919).integers(0, 1 << 63, 2 * COORDINATES + BANDS + 2, dtype=np.uint64)


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted by text and hash, and where each text's begin and the last one's end."""
    data, offsets = content(column)
    data = LOWER[data]
    starts, ends, of = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    edges = np.searchsorted(of, np.arange(len(column) + 1))
    full = window_starts(of, k)
    n = np.diff(edges)
    short = np.flatnonzero((n > 0) & (n < k))
    first = np.concatenate([full, edges[short]])
    past = np.concatenate([full + k, edges[short + 1]])
    hashes, of = span_hashes(words, first, past, SEQUENCE_BASE), of[first]
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.searchsorted(of[new], np.arange(len(column) + 1))


def sketches(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One row of COORDINATES values for each text that has shingles."""
    sizes = np.diff(edges)
    sizes = sizes[sizes > 0]
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sizes), COORDINATES), empty)
    flat, of = out.reshape(-1), np.repeat(np.arange(len(sizes)), sizes)
    for turn in range(2 * COORDINATES):
        if turn:
            open_ = (out == empty).any(1)
            if not open_.any():
                break
            hashes, of = hashes[stay := open_[of]], of[stay]
        values = mix(hashes ^ _SEEDS[turn])
        bins = (values & np.uint64(COORDINATES - 1)).astype(np.int64) if turn < COORDINATES else turn - COORDINATES
        # the round stands in the leading bits: what an earlier round has filled stays
        np.minimum.at(flat, of * COORDINATES + bins, (np.uint64(turn) << np.uint64(56)) | (values >> np.uint64(8)))
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(_SEEDS[2 * COORDINATES : 2 * COORDINATES + BANDS], (len(sketch), BANDS)).copy()
    for row in range(ROWS):
        keys = mix(keys ^ sketch[:, row::ROWS]) + np.uint64(row)
    return keys


def describe(k: int):
    """id and text to id, n_shingles, the digest of the set and the bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, edges = shingles(piece.column("text"), k)
                sizes = np.diff(edges)
                some = np.flatnonzero(sizes)
                digests = []
                for seed in _SEEDS[-2:]:
                    digest = np.zeros(len(sizes), np.uint64)
                    if len(some):
                        digest[some] = np.add.reduceat(mix(hashes ^ seed), edges[some])
                    digests.append(pa.array(digest.view(np.int64)))
                keys = bands(sketches(hashes, edges))
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sizes.astype(np.int64)), *digests, lists], names=["id", "n_shingles", "d1", "d2", "bands"])

    return run


def to_sets(k: int):
    """roles and text to roles and the packed shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, edges = shingles(piece.column("text"), k)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("roles"), binaries(hashes, edges)], names=["id", "roles", "members"])

    return run


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have percent / 100 of their union in common."""
    if not len(one) or 100 * min(len(one), len(other)) < percent * max(len(one), len(other)):
        return False
    spot = np.searchsorted(other, one)
    shared = int(np.count_nonzero(other[np.minimum(spot, len(other) - 1)] == one))
    return 100 * shared >= percent * (len(one) + len(other) - shared)


def compare(percent: int):
    """Rows of a (team, chunk), its hubs first, to confirmed links. Of the hubs that a row is similar to, those that are known to hang together give one link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs, ties = None, {}, {}

        def root(x: int) -> int:
            while ties.setdefault(x, x) != x:
                ties[x] = x = ties[ties[x]]
            return x

        for batch in batches:
            found = []
            for team, chunk, against, id_, members in zip(*(batch.column(c) for c in ("team", "chunk", "hubs", "id", "members"))):
                one, id_ = np.frombuffer(members.as_buffer(), np.uint64), id_.as_py()
                if at != (team.as_py(), chunk.as_py()):
                    at, hubs, ties = (team.as_py(), chunk.as_py()), {}, {}
                if not against.is_valid:
                    hubs.setdefault(id_, []).append(one)
                    continue
                near = [h for h in against.as_py() if any(similar(one, s, percent) for s in hubs.get(h, ()))]
                for i, h in enumerate(near):
                    if i == 0 or root(h) != root(near[0]):
                        found.append((id_, h))
                        ties[root(h)] = root(near[0])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def few(rows: DataFrame, size: Column | int = 80) -> DataFrame:
    """rows to be broadcast if their sizes in bytes add up to little; else Spark joins them by a shuffle."""
    total = rows.agg(F.sum(F.lit(size) if isinstance(size, int) else size)).first()[0] or 0
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows


def confirmed(docs: DataFrame, against: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between the ids of against (id, hubs) and those of their hubs whose full sets are similar enough.

    Ids with the same least hub are a team; a team of many has several chunks. Each text is read once, and its set is sent once to its chunk, and to every chunk
    that it is a hub in.
    """
    against = written(against.withColumn("team", F.array_min("hubs")), "neardup-against")
    many = few(against.groupBy("team").count().filter(F.col("count") > GROUP))
    chunks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / GROUP)
    dealt = against.join(many, "team", "left").select("id", "team", F.pmod(F.xxhash64("id"), chunks).alias("chunk"), "hubs")
    hubs = dealt.groupBy("team", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("all"))
    hubs = hubs.select(F.explode("all").alias("id"), "team", "chunk", F.lit(None).cast("array<long>").alias("hubs"))
    roles = dealt.unionByName(hubs).groupBy("id").agg(F.collect_list(F.struct("team", "chunk", "hubs")).alias("roles"))
    listed = F.aggregate("roles", F.lit(0), lambda n, role: n + 64 + 8 * F.coalesce(F.size(role["hubs"]), F.lit(0)))
    roles = written(roles, "neardup-roles")
    kind = "array<struct<team:long,chunk:long,hubs:array<long>>>"
    sets = in_batches(docs.join(few(roles, 64 + listed), "id").select("id", "roles", "text"), to_sets(k), f"id long, roles {kind}, members binary")
    each = sets.select("id", "members", F.explode("roles").alias("role")).select("role.*", "id", "members")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = each.repartition(parts, "team", "chunk").sortWithinPartitions("team", "chunk", F.col("hubs").isNotNull())
    links = written(in_batches(grouped, compare(percent), "a long, b long"), "neardup-links")
    discard(against, roles)
    return links


def components(links: DataFrame) -> DataFrame:
    """id and component, the least id that links (a, b) lead to, for every id in a link.

    Each turn an id takes the least component of its neighbours, and then the component which that one's own id has by now.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "components-links")
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component"))
    labels = written(labels, "components")
    while True:
        known = few(labels)
        own = labels.select("id", F.col("component").alias("old"), "component")
        heard = both.join(known.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.lit(None).cast("long").alias("old"), "component")
        lower = own.unionByName(heard).groupBy("id").agg(F.max("old").alias("old"), F.min("component").alias("through"))
        lower = lower.join(known.select(F.col("id").alias("through"), "component"), "through").select("id", "old", "component")
        lower, before = written(lower, "components"), labels
        discard(before)
        labels = lower.select("id", "component")
        labels.scratch = lower.scratch
        if not lower.filter(F.col("component") != F.col("old")).limit(1).count():
            return labels


def rounds(docs: DataFrame, classes: DataFrame, k: int, percent: int, more: DataFrame) -> DataFrame:
    """Components of the classes' ids, after every bucket has been settled. more: links known beforehand."""
    keys = classes.select("id", F.explode("bands").alias("key"))
    sign = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"sign{i}") for i in (1, 2)]
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), *sign).filter("n > 1")
    # bands that hold the same members are one bucket
    shared = written(shared.groupBy("least", "n", "sign1", "sign2").agg(F.min("key").alias("key")).select("key", "least", "n"), "neardup-buckets")
    members = keys.join(shared, "key")
    drawn = F.pmod(F.xxhash64("id"), F.greatest(F.floor(F.col("n") / HUBS), F.lit(1))) == 0
    state = written(members.select("key", "id", (drawn | (F.col("id") == F.col("least"))).alias("tested"), F.col("id").alias("component")), "neardup-state")
    hubs = state.filter("tested").groupBy("key").agg(F.collect_list("id").alias("hubs"))
    links, at_once, turn = more, HUBS, 0
    while True:
        near_hubs = written(hubs, "neardup-hubs")
        near = state.join(near_hubs, "key")
        if at_once > HUBS:
            near = near.select("id", F.transform(F.filter("hubs", lambda h: h["component"] != F.col("component")), lambda h: h["id"]).alias("hubs"))
        near = near.groupBy("id").agg(F.array_remove(F.array_distinct(F.flatten(F.collect_list("hubs"))), F.col("id")).alias("hubs")).filter(F.size("hubs") > 0)
        links = links.unionByName(confirmed(docs, near, k, percent))
        labels = components(links)
        before = state
        state = state.drop("component").join(few(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
        state = written(state, "neardup-state")
        discard(before, near_hubs)
        # of a bucket's untested members all must be held against the others, but for those of one component
        waiting = state.filter("not tested").groupBy("key", "component").agg(F.count("*").alias("n"))
        open_ = waiting.groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
        open_ = written(open_.select("key", F.col("largest.component").alias("rest"), (F.col("all") - F.col("largest.n")).alias("left")), "neardup-open")
        if not open_.limit(1).count():
            return labels
        at_once, turn = min(16 * at_once, MOST_HUBS), turn + 1
        before = state
        state = state.filter("not tested").join(few(open_), "key")
        drawn = F.pmod(F.xxhash64("id", F.lit(turn)), F.greatest(F.floor(F.col("left") / at_once), F.lit(1))) == 0
        state = written(state.select("key", "id", "component", ((F.col("component") != F.col("rest")) & drawn).alias("tested")), "neardup-state")
        discard(before)
        hubs = state.filter("tested").groupBy("key").agg(F.collect_list(F.struct("id", "component")).alias("hubs"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id and kept for every row of docs: components of texts whose shingle sets have percent/100 of their union in common."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = in_batches(docs, describe(k), "id long, n_shingles long, d1 long, d2 long, bands array<long>")
    rows = written(rows, "neardup-sketches")
    real = rows.filter("n_shingles > 0 and id is not null")
    classes = real.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("id", "bands")).alias("first"))
    classes = written(classes.select("n_shingles", "d1", "d2", "first.*"), "neardup-classes")
    # rows that share an id but not a text tie their classes together
    digest = F.struct("n_shingles", "d1", "d2")
    several = real.groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).filter("a <> b").select("id")
    held = real.join(several, "id").join(classes.select("n_shingles", "d1", "d2", F.col("id").alias("rep")), ["n_shingles", "d1", "d2"])
    tied = held.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps"))
    tied = tied.select("a", F.explode("reps").alias("b")).filter("a <> b")
    labels = rounds(docs.filter("id is not null"), classes, k, percent, written(tied, "neardup-tied"))
    named = classes.join(labels, "id", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "id").alias("component_id"))
    found = rows.drop("bands").join(named, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return found.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id; of rows that share it, the first by their JSON. Rows with a null id stay."""
    found = near_duplicates(docs, k, percent)
    found = written(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).filter("doc_id is not null"), "neardup-kept")
    plain, names = numbered(docs)
    id_ = names[docs.columns.index("doc_id")]
    stay = plain.join(few(found.filter("not kept").select(F.col("doc_id").alias(id_))), id_, "left_anti").select(*names)
    several = found.filter("kept and n > 1").select(F.col("doc_id").alias(id_))
    if several.limit(1).count():
        repeated = stay.join(several, id_, "left_semi").select(*names).groupBy(id_).agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("row"))
        stay = stay.join(several, id_, "left_anti").select(*names).unionByName(repeated.select("row.*"))
    return stay.toDF(*docs.columns)


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(ws[p : p + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM texts)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM texts WHERE len(ws) BETWEEN 1 AND 2)),
sizes AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 85 * (m.n + n.n - c)),
steps AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS found FROM steps UNION SELECT r.doc_id, s.b FROM reach r JOIN steps s ON s.a = r.found)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c.component, t.doc_id) AS component_id, coalesce(c.component, t.doc_id) = t.doc_id AS kept
FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(found) AS component FROM reach GROUP BY doc_id) c USING (doc_id)
"""
