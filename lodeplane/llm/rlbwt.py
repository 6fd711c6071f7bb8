"""Exact substring dedup with run-length compressed suffix indexes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id.

1. Documents with equal texts (by SHA-256) are one: all but the smallest id go whole (if long enough).
2. Every string of LENGTH bytes belongs to its smallest K-byte substring by hash. Consecutive
   strings with the same one form a stretch; equal strings are in stretches with equal hashes, so
   a stretch can be dealt to the bucket of its hash and no match is lost. Equal stretches of one
   batch (found by a hash, their bytes are compared) are settled there: only those of the smallest id travel.
3. In a bucket, hashes seen in one document only are dropped, and equal stretches settled. What is
   left, different stretches around a shared substring, is indexed in blocks: the suffix array is
   sorted by doubling, its Burrows-Wheeler transform run-length compressed, and positions are sampled
   at run ends. Match lengths between neighbours are compared at run heads only; along the text
   they fall by one for each byte inside a run, which streams them to all other positions. That holds
   in a true suffix order only: each stretch ends in a sentinel that differs from all others, so
   suffixes are sorted up to theirs.
4. Neighbours that match on LENGTH bytes form classes; positions whose class has a smaller id are
   marked. Marks return to their documents as intervals.

Defined results: null texts are empty. Rows without doc_id are no source and stay whole. Rows that
share a doc_id are one document: they don't remove from each other, and marks of either apply to
rows with the same text only, so texts of such ids are numbered. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fill_parts, text
from .wordhash import buffers, mix, powers

LENGTH, K = 50, 20
SPAN = LENGTH - K + 1
BLOCK_BYTES = 2 << 20
BROADCAST_ROWS = 200_000
SENTINEL = 255  # no byte of UTF-8
KINDS = ("<i8", "<i8", "<u4", "u1", "u1", "u1", "<i8", "<i8", "<u4", "u1")  # of what _pack takes; ids as steps, a stretch has 2 * LENGTH - K bytes at most


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * powers(len(sums))[1][a] + (b - a).astype(np.uint64))


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, end (in data), place of the K bytes (from the start), their hash and content hash of every stretch."""
    n = len(data) - K + 1
    empty = np.zeros(0, np.int64)
    if n < SPAN:
        return empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = _sums(data)
    grams = mix((sums[K:] - sums[:-K]) * powers(len(data) + 1)[1][:n] + np.uint64(K))
    low = (grams & ~np.uint64(0xFFFFFF)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFF))
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - SPAN + 1], low[SPAN - width :][: n - SPAN + 1])
    windows = np.arange(len(low))
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(len(sizes)), sizes)[: len(windows)]
    ok = (np.repeat(offsets[1:], sizes)[: len(windows)] - windows) >= LENGTH
    windows, rows = windows[ok], rows[ok]
    if not len(windows):
        return empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = windows + ((low[ok] & np.uint64(0xFFFFFF)).astype(np.int64) - windows) % (1 << 24)
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])]))
    start, end = windows[head], np.append(windows[head[1:] - 1], windows[-1]) + LENGTH
    return rows[head], start, end, at[head] - start, grams[at[head]], _hash(sums, start, end)


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of many intervals, one after the other."""
    size = end - start
    return data[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(size) else data[:0]


def _pack(doc, number, start, size, place, data, done_doc, done_number, done_start, done_size) -> bytes:
    arrays = [x.astype(kind) for x, kind in zip((np.diff(doc, prepend=0), number, start, size, place, data, np.diff(done_doc, prepend=0), done_number, done_start, done_size), KINDS, strict=True)]
    head = np.array([len(a) for a in arrays], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8 * len(KINDS)
    for n, kind in zip(np.frombuffer(raw, "<i8", len(KINDS)), KINDS, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * out[-1].itemsize
    out[0], out[6] = np.cumsum(out[0]), np.cumsum(out[6])
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number."""
    return np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes (8 at least) from a equal those from b, eight at a time."""
    eights = _eights(data)
    out = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        at = np.minimum(k, size - 8)
        out &= eights[a + at] == eights[b + at]
    return out


def settle(content: np.ndarray, doc: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which stretches have an equal one in a document with a smaller id."""
    out = np.zeros(len(doc), bool)
    if len(doc):
        order = np.argsort(content)
        new = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        a, b = order[1:][~new[1:]], order[:-1][~new[1:]]
        if not ((size[a] == size[b]).all() and _same(data, begin[a], begin[b], size[a]).all()):  # different ones of one hash
            seen: dict[bytes, int] = {}
            content = np.array([seen.setdefault(data[x : x + n].tobytes(), len(seen)) for x, n in zip(begin, size, strict=True)])
            order = np.argsort(content)
            new = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        head = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[order], head)
        out[order] = doc[order] > np.repeat(least, np.diff(np.append(head, len(order))))
    return out


class RunLengthIndex:
    """Suffix order of a text, kept as runs of its Burrows-Wheeler transform with positions sampled at their ends.
    Every sentinel is a byte of its own, less than those after it, so no match goes on behind one."""

    def __init__(self, t: np.ndarray) -> None:
        self.text = t
        n = len(t)
        stops = np.append(np.flatnonzero(t == SENTINEL), n)
        sizes = np.diff(stops, prepend=-1)
        left = (np.repeat(stops, sizes) - np.arange(n + 1) + 1)[:n]  # bytes up to the sentinel, and that
        padded = np.concatenate([t, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : n + k]
        short = np.flatnonzero(left < 8)
        key[short] &= ~np.uint64(0) << (8 * (8 - left[short])).astype(np.uint64)
        order = np.argsort(key)
        rank, reach = self._rank(key, order), 8
        while reach < sizes.max() and rank.max(initial=0) + 1 < n:
            after = np.zeros(n, np.uint64)
            after[: max(n - reach, 0)] = rank[reach:] + 1
            after[left <= reach] = 0
            key = (rank.astype(np.uint64) << np.uint64(32)) | after
            order = np.argsort(key)
            rank, reach = self._rank(key, order), 2 * reach
        if n and rank.max() + 1 < n:  # what is equal up to its sentinel is in the order of the text, as the sentinels are
            order = np.argsort((rank.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))
        before = np.concatenate([[SENTINEL], t[:-1]]).astype(np.uint8)[order] if n else t
        self.order = order
        cut_here = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == SENTINEL)]) if n else np.zeros(0, bool)
        self.run_starts = np.flatnonzero(cut_here)
        self.run_chars = before[self.run_starts]
        self.sampled_ends = order[np.append(self.run_starts[1:], n) - 1] if n else order

    @staticmethod
    def _rank(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        s = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)])) if len(key) else s.astype(np.int64)
        return rank

    def match_lengths(self) -> np.ndarray:
        """For each text position the match with its neighbour before it in suffix order:
        compared at run heads against the sampled end of the run before, streamed to all others."""
        n = len(self.text)
        heads = self.order[self.run_starts]
        others = np.concatenate([[n], self.sampled_ends[:-1]])
        padded = np.append(self.text, np.uint8(SENTINEL))
        size, alive, k = np.zeros(len(heads), np.int64), np.arange(len(heads))[1:], 0
        while len(alive):
            byte = padded[heads[alive] + k]
            alive = alive[(byte == padded[others[alive] + k]) & (byte != SENTINEL)]
            size[alive] += 1
            k += 1
        known = np.full(n, -1, np.int64)
        known[heads] = size
        anchor = np.maximum.accumulate(np.where(known >= 0, np.arange(n), 0))
        return np.maximum(known[anchor] - (np.arange(n) - anchor), 0)

    def smaller_owner(self, owner: np.ndarray) -> np.ndarray:
        """Positions whose LENGTH bytes also start at a position with a smaller owner."""
        if not len(self.text):
            return np.zeros(0, bool)
        new = self.match_lengths()[self.order] < LENGTH
        new[0] = True
        at = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(owner[self.order], at), np.diff(np.append(at, len(new))))
        out = np.zeros(len(new), bool)
        out[self.order] = owner[self.order] > least
        return out


def _indexed(doc: np.ndarray, number: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals (doc, number, start, size) to be removed from stretches, whose bytes are data."""
    ends = np.cumsum(size + 1)
    t = np.full(int(ends[-1]), SENTINEL, np.uint8)
    inside = np.ones(len(t), bool)
    inside[ends - 1] = False
    t[inside] = data
    begin = ends - size - 1
    which = np.repeat(np.arange(len(size)), size + 1)
    marked = RunLengthIndex(t).smaller_owner(doc[which]) & (np.arange(len(t)) + LENGTH < ends[which])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]  # windows of one stretch are never next to those of another: its last bytes begin none
    return doc[which[a]], number[which[a]], start[which[a]] + a - begin[which[a]], b - a + LENGTH - 1


def _bucket(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Intervals (doc, number, start, size) to be removed, from all packed stretches of one bucket."""
    parts = [_unpack(b) for b in blobs]
    blobs.clear()
    doc, number, start, size, place, data, *done = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    yield done[0], done[1], done[2].astype(np.int64), done[3].astype(np.int64)
    start, size = start.astype(np.int64), size.astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    if not len(doc):
        return
    key = np.zeros(len(doc), np.uint64)  # of the K bytes around which a stretch is; a clash only puts two together
    for k in sorted({min(k, K - 8) for k in range(0, K, 8)}):
        key = mix(key + _eights(data)[begin + place + k])
    order = np.argsort(key)
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    count = np.diff(np.append(head, len(order)))
    shared = np.minimum.reduceat(doc[order], head) != np.maximum.reduceat(doc[order], head)
    blocks = np.repeat(np.cumsum(np.add.reduceat(size[order], head) * shared) // BLOCK_BYTES, count)[np.repeat(shared, count)]
    order = order[np.repeat(shared, count)]
    for a, b in zip(x := np.append(np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])), len(order)) if len(order) else [], x[1:], strict=False):
        at = order[a:b]
        block = gather(data, begin[at], begin[at] + size[at])
        stop = np.cumsum(size[at])
        content = _hash(_sums(block), stop - size[at], stop)
        gone = settle(content, doc[at], block, stop - size[at], size[at])
        yield doc[at][gone], number[at][gone], start[at][gone], size[at][gone]
        left = ~gone
        if left.any():
            of = at[left]
            yield _indexed(doc[of], number[of], start[of], size[of], block[np.repeat(left, size[at])])


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, number, a, b: bytes a to b of documents (doc_id long, number long, text) that go. The number
    tells texts of one doc_id apart; no row comes twice."""
    n = fill_parts(docs.sparkSession)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held: list[tuple] = []
            for first, data, offsets in buffers(batch.column(2), BLOCK_BYTES):
                rows, start, end, place, gram, content = stretches(data, offsets)
                held.append((ids[first + rows], numbers[first + rows], start - offsets[rows], end - start, place, gram, content, gather(data, start, end)))
                if sum(len(x[-1]) for x in held) > 6 * BLOCK_BYTES:
                    yield _dealt(held, n)
                    held = []
            if held:
                yield _dealt(held, n)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        if blobs:
            for doc, number, start, size in _bucket(blobs):
                yield from _by_document(doc, number, start, start + size)

    dealt = docs.select("doc_id", "number", "text").mapInArrow(deal, "bucket int, packed binary")
    found = dealt.repartitionById(n, F.col("bucket")).mapInArrow(index, "doc_id long, number long, a array<int>, b array<int>")
    return cut(found, "repeats").groupBy("doc_id", "number").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))


def _by_document(doc: np.ndarray, number: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((a, number, doc) if number.any() else (a, doc))
    doc, number, a, b = doc[order], number[order], a[order], b[order]
    if len(doc):
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])]))
        ends = pa.array(np.append(head, len(doc)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(number[head]), *lists], names=["doc_id", "number", "a", "b"])


def _dealt(held: list[tuple], n: int) -> pa.RecordBatch:
    doc, number, start, size, place, gram, content, data = (np.concatenate(x) for x in zip(*held, strict=True))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    gone = settle(content, doc, data, begin, size)
    bucket = (gram >> np.uint64(32)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    packed, numbers = [], []
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in range(n):
        at = order[bounds[k] : bounds[k + 1]]
        if len(at):
            live, done = at[~gone[at]], at[gone[at]]
            packed.append(_pack(doc[live], number[live], start[live], size[live], place[live], gather(data, begin[live], begin[live] + size[live]), doc[done], number[done], start[done], size[done]))
            numbers.append(k)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])


def strip_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) for every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text().alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    digests = cut(own.select("doc_id", digest, F.octet_length("text").alias("size")), "digests")
    least = digests.where(f"size >= {LENGTH} and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    whole = cut(digests.join(least, "digest").where("doc_id > least").select("doc_id", "digest").distinct(), "whole")
    several = digests.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    texts = cut(digests.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().withColumn("number", F.monotonically_increasing_id() + 1), "texts")
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    n_whole, n_texts = whole.count(), texts.count()
    keyed = own.select("doc_id", "text", digest)
    if n_texts:
        keyed = keyed.join(few(texts, n_texts), ["doc_id", "digest"], "left").withColumn("number", F.coalesce("number", F.lit(0)))
    else:
        keyed = keyed.withColumn("number", F.lit(0).cast("long"))
    distinct = keyed.where(F.col("doc_id").isNotNull()).join(few(whole, n_whole), ["doc_id", "digest"], "left_anti").select("doc_id", "number", "text")
    if n_texts:
        distinct = distinct.where("number = 0").unionByName(distinct.where("number > 0").dropDuplicates(["doc_id", "number"]))
    spans = cut(repeated(distinct), "spans")
    marked = keyed.join(few(whole.withColumn("all", F.lit(True)), n_whole), ["doc_id", "digest"], "left")
    n_ids = spans.count()
    key = ["doc_id", "number"]
    if n_ids <= BROADCAST_ROWS:  # only documents with spans move
        ids = F.broadcast(spans.select(*key))
        none = F.lit(None).cast("array<int>")
        marked = marked.join(ids, key, "left_anti").withColumns({"a": none, "b": none}).unionByName(marked.join(ids, key, "left_semi").join(spans, key))
    else:
        marked = marked.join(spans, key, "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(*row.values()) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.select("doc_id", "text", "all", "a", "b").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _kept(_, t: str, gone: bool | None, a: list[int] | None, b: list[int] | None) -> tuple[int, int, int, bytes]:
    data = t.encode()
    if gone:
        return len(data), len(data), 1, b""
    spans: list[list[int]] = []
    for x, y in sorted(zip(a or [], b or [], strict=True)):
        if spans and x <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], y)
        else:
            spans.append([x, y])
    at, kept = 0, []
    for x, y in spans:
        kept.append(data[at:x])
        at = y
    kept.append(data[at:])
    return len(data), sum(y - x for x, y in spans), len(spans), b"".join(kept)
