"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct runs of k words. Each set gets registers that hold exponentially
spaced, truncated minima of exponential hash values: an element sends an ascending Poisson
sequence of values, each to a random register, and stops once its values exceed all minima so
far. Registers of parts of a set merge by their minimum, and two sets agree in a register with a
probability close to their Jaccard similarity.

1. Equal sets are one node, named by a 128-bit digest.
2. Bands of registers are hashed; nodes that share a band meet in a bucket. With 40 bands of 5 a
   pair at the threshold of 0.8 is missed with a probability of about 1e-7.
3. Within a bucket one pivot, the node that meets most others in all buckets, is compared with all
   others. A candidate pair is estimated from its registers by maximum likelihood, with the set sizes
   known. Pairs whose estimate is more than MARGIN (six standard deviations) under the threshold
   go; all others are verified on their full sets.
4. Buckets whose other nodes are one component by then are done, which most are. Nodes of the other
   buckets are grouped by shared buckets, sorted by set size and cut into chunks of CHUNK elements;
   chunks whose sizes can be similar are compared with each other, two at a time, by counting common
   elements with a matrix product. Only links that join what wasn't joined leave a task; pairs are
   never written out.
5. Components of the verified links give component_id.

Defined results: documents without words are linked with nothing. Rows without doc_id are linked
with nothing, have no component and are kept. Rows that share doc_id and text share their
component; the stage keeps one of them. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text
from .components import components
from .wordhash import mix, sets

BANDS, ROWS = 40, 5
M = BANDS * ROWS
B = 1.001
LOW = 4000  # register value at a minimum of 1; minima from e**-61 to e**4 keep their place
MARGIN = 0.17
CHUNK = 60_000
COLUMNS = 4096
BROADCAST_NODES = 500_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def registers(groups: list[np.ndarray]) -> np.ndarray:
    """Registers of each set of 64-bit hashes, as a matrix of 16-bit values."""
    minima = np.full(len(groups) * M, np.inf)
    owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    state = np.concatenate(groups) if groups else np.zeros(0, np.uint64)
    reached = np.zeros(len(state))
    while len(state):
        state = state + GOLD
        drawn = mix(state)
        reached = reached - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / M
        limit = minima.reshape(-1, M).max(axis=1)
        on = reached < limit[owner]
        state, owner, reached, drawn = state[on], owner[on], reached[on], drawn[on]
        spot = (mix(drawn ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) % np.uint64(M)
        np.minimum.at(minima, owner * M + spot.astype(np.int64), reached)
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(minima) / np.log(B)) + LOW, 0, 65535).astype(np.uint16).reshape(-1, M)


def band_hashes(regs: np.ndarray) -> np.ndarray:
    rows = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, rows.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out ^ (rows[:, :, j] + np.uint64(j << 20)))
    return out.view(np.int64)


def estimate(u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of registers with known set sizes."""
    more, less = (u > v).sum(axis=1), (u < v).sum(axis=1)
    same = M - more - less
    a, b = n_u / (n_u + n_v), n_v / (n_u + n_v)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(a - b * j), p(b - a * j)
        tiny = 1e-300
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(a)), np.minimum(a / b, b / a)
    for _ in range(40):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, h (hash of the text), n, node (digest of the set), regs and bands; the last three are null for empty sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, held, size = batch.select([0, 1]), 0, [], 0
            for s in sets(batch.column(2), k):
                held.append(s)
                size += len(s) + 50
                if size > 300_000:
                    yield _sketched(rows.slice(at, len(held)), held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield _sketched(rows.slice(at, len(held)), held)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text()).alias("h"), text().alias("text")).mapInArrow(run, "doc_id long, h long, n long, node binary, regs binary, bands array<long>")


def _sketched(rows: pa.RecordBatch, groups: list[np.ndarray]) -> pa.RecordBatch:
    regs = registers(groups)
    bands = band_hashes(regs)
    some = [len(g) > 0 for g in groups]
    node = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() if s else None for g, s in zip(groups, some, strict=True)]
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array([len(g) for g in groups], pa.int64()), pa.array(node, pa.binary()), pa.array([r.tobytes() if s else None for r, s in zip(regs, some, strict=True)], pa.binary()), pa.array([b if s else None for b, s in zip(bands, some, strict=True)], pa.list_(pa.int64()))],
        names=["doc_id", "h", "n", "node", "regs", "bands"],
    )


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that their registers don't rule out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
                j = estimate(u, v, batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float))
                yield batch.select(["a", "b"]).filter(pa.array(j >= threshold / 100 - MARGIN))

    of = lambda x: nodes.select(F.col("node").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return sized.mapInArrow(run, pairs.schema)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, step = [], 64
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for x, y in zip(sets(part.column("ta"), k), sets(part.column("tb"), k), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    kept.append(100 * both >= threshold * (len(x) + len(y) - both))
            if kept:
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, pairs.schema)


def _block_links(a: list[np.ndarray], b: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of similar pairs of sets, by exact counts of common elements."""
    every = np.unique(np.concatenate([*a, *b]))
    common = np.zeros((len(a), len(b)), np.float32)
    cells = []
    for side in (a, b):
        owner, column = np.repeat(np.arange(len(side)), [len(x) for x in side]), np.searchsorted(every, np.concatenate(side))
        order = np.argsort(column, kind="stable")
        cells.append((owner[order], column[order]))
    for at in range(0, len(every), COLUMNS):
        dense = []
        for side, (owner, column) in zip((a, b), cells, strict=True):
            x, y = np.searchsorted(column, [at, at + COLUMNS])
            dense.append(np.zeros((len(side), COLUMNS), np.float32))
            dense[-1][owner[x:y], column[x:y] - at] = 1
        common += dense[0] @ dense[1].T
    n_a, n_b = (np.array([len(x) for x in side], float) for side in (a, b))
    return np.nonzero(100 * common >= threshold * (n_a[:, None] + n_b[None, :] - common))


def _forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """As few of the links as join what all of them join."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = v = root.get(up, up)
        return v

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a, b, strict=True):
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
            kept[0].append(x)
            kept[1].append(y)
    return kept


def _open_links(live: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links among nodes (bucket, node) that share buckets, compared chunk by chunk."""
    star = live.join(live.groupBy("bucket").agg(F.min("node").alias("first")), "bucket")
    groups = components(star.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("label", "grp")
    so_far = F.sum("n").over(Window.partitionBy("grp").orderBy("n", "node"))
    member = cut(groups.join(nodes.select("node", "n"), "node").withColumn("chunk", F.floor(so_far / CHUNK)), "members")
    chunk = member.groupBy("grp", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = chunk.select("grp", F.col("chunk").alias("j"), F.col("low").alias("low_j"))
    pair = cut(chunk.withColumnRenamed("chunk", "i").join(other, "grp").where((F.col("i") <= F.col("j")) & (100 * F.col("high") >= threshold * F.col("low_j"))).select("grp", "i", "j"), "blocks")
    sides = pair.select("grp", "i", "j", F.col("i").alias("chunk")).unionByName(pair.where("i < j").select("grp", "i", "j", F.col("j").alias("chunk")))
    rows = member.join(sides, ["grp", "chunk"]).join(texts, "node").select("grp", "i", "j", "chunk", "node", "text")

    def compare(table: pa.Table) -> pa.Table:
        own = list(sets(table.column("text").combine_chunks(), k))
        where = table.column("chunk").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = np.flatnonzero(where == i), np.flatnonzero(where == j)
        r, c = _block_links([own[q] for q in x], [own[q] for q in y], threshold)
        keep = (x[r] < y[c]) if i == j else np.ones(len(r), bool)
        a, b = _forest(x[r[keep]].tolist(), y[c[keep]].tolist())
        node = table.column("node").combine_chunks()
        return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})

    return rows.groupBy("grp", "i", "j").applyInArrow(compare, "a binary, b binary")


def links(sk: DataFrame, texts_of, k: int, threshold: int) -> DataFrame:
    """a, b: links between nodes that join all nodes of each component. texts_of(wanted): node, text of wanted (node, doc_id, h)."""
    nodes = cut(sk.where("node is not null and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("at"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "nodes")
    each = nodes.select("node", F.explode("bands").alias("bucket"))
    live = cut(each.join(each.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "bucket"), "buckets")
    live = cut(live.join(live.groupBy("node").agg(F.sum("c").alias("meets")), "node").select("bucket", "node", "meets"), "buckets")
    texts = cut(texts_of(live.select("node").distinct().join(nodes.select("node", "at.doc_id", "at.h"), "node")), "texts")
    pivots = cut(live.groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("p")).select("bucket", F.col("p.node").alias("pivot")), "pivots")
    pairs = live.join(pivots, "bucket").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    found = cut(_verified(_likely(pairs, nodes, threshold), texts, k, threshold), "links")
    labels = components(found)
    left = live.join(pivots, "bucket").where("node <> pivot").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    still = left.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    left = cut(left.join(still, "bucket", "left_semi").select("bucket", "node"), "open")
    if left.isEmpty():
        return found
    return found.unionByName(cut(_open_links(left, nodes, texts, k, threshold), "links"))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, kept: one row per document row."""
    sk = cut(sketches(docs, k), "sketches")

    def texts_of(wanted: DataFrame) -> DataFrame:
        wanted = cut(wanted, "wanted")
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text()).alias("h"), text().alias("text")).join(side, ["doc_id", "h"])
        return own.dropDuplicates(["node"]).select("node", "text")

    found = links(sk, texts_of, k, threshold)
    labels = components(found)
    rows = sk.select("doc_id", "h", F.col("n").alias("n_shingles"), "node")
    rows = rows.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "comp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "h", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """docs without all but one document of each component, with all their columns."""
    near = cut(near_duplicates(docs, k, threshold), "near")
    gone = near.where(~F.col("kept")).select(F.col("doc_id").alias("_i"), F.col("h").alias("_h")).distinct()
    h = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(gone, (docs["doc_id"].cast("long") == gone["_i"]) & (h == gone["_h"]), "left_anti")
    if near.where("kept and doc_id is not null").groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))
