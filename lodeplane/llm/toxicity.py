"""Toxicity by nearest labelled examples.

Terms: lower-cased words, and the beginnings of longer ones (PREFIX letters and a dash); those whose presence goes with the label (chi-square over all learning rows
at least MIN_CHI2, in MIN_DOCS of them or more) are kept, but for
words whose beginning is as strong a term.
Examples: a bounded sample of MAX_EXAMPLES learning rows, the smallest by a hash of the id, as
TF-IDF vectors (1 + log tf, smoothed idf from all learning rows) of unit length. All words that are
no term share one dimension of the fixed weight REST, so that one weak term among other words is
less than many. Vectors are indexed
by inverted lists in blocks of BLOCK examples, with the largest weight of each term in each block:
a block is scored only while its bound can still beat the K-th best, so the K nearest by cosine are exact. Where more
than one of SPARSE blocks are left, their lists are read as a whole, which is cheaper than to skip in them; the WIDE longest
ones are laid out as rows for that, which many texts multiply at once. Similarities are rounded to 9 digits.
Score: the share of toxic ones among the K nearest, weighted by similarity, read through a
calibration table made by leaving each example out in turn. Texts without terms get the rate of toxic
ones among such examples. The nearest ids are the evidence.

The model is bounded by its parameters and is broadcast. Its counts are over all learning rows.

Defined results: null texts are empty. Documents without a label are scored and not learnt from. An id
with several labels is toxic if one says so; rows without label count as unlabelled. Without any
learning rows all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text

MAX_EXAMPLES = 6000
MIN_CHI2, MIN_DOCS = 20.0, 4
BLOCK, K = 64, 15
FIRST, SPARSE, WIDE = 5, 8, 512
AT_ONCE = 64
PREFIX, REST = 5, 3.0
BINS = 20
MAX_SAID = 50_000
BROADCAST_ROWS = 1_000_000
WORD = re.compile(r"\w+")


def learns(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def bag(t: str, terms: Container[str]) -> dict[str, int]:
    """How often each of the terms is in a text."""
    out: dict[str, int] = {}
    for w, n in Counter(WORD.findall(t.lower())).items():
        if w in terms:
            out[w] = n
        if len(w) > PREFIX and (w := w[:PREFIX] + "-") in terms:
            out[w] = out.get(w, 0) + n
    return out


class TermsOf(dict):
    """The terms, as numbers, that a word gives."""

    def __init__(self, at: dict[str, int]) -> None:
        self.at = at

    def __missing__(self, w: str) -> tuple[int, ...]:
        out = tuple(self.at[t] for t in ((w, w[:PREFIX] + "-") if len(w) > PREFIX else (w,)) if t in self.at)
        if len(self) > MAX_SAID:
            self.clear()
        self[w] = out
        return out


class Model:
    """Terms with idf, and the block-max index of the examples."""

    def __init__(self, terms: list[str], idf: list[float], ids: list[int], labels: list[int], bags: list[dict[str, int]]) -> None:
        self.at = {t: k for k, t in enumerate(terms)}
        self.idf = np.array(idf)
        self.labels = np.array(labels, float)
        vectors = [self.vector(b) for b in bags]
        plain = (np.array([len(terms)], np.int64), np.ones(1))
        vectors = [v if len(v[0]) else plain for v in vectors]
        # examples with the same strongest term stand together, which makes block bounds tight
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = self.labels[order] if len(order) else self.labels
        self.vectors = [vectors[i] for i in order]
        n_blocks = -(-len(order) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *(v[0] for v in self.vectors)])
        who = np.repeat(np.arange(len(order)), [len(v[0]) for v in self.vectors])
        weight = np.concatenate([np.zeros(0), *(v[1] for v in self.vectors)])
        by = np.lexsort((who, term))
        self.who, self.weight = who[by], weight[by]
        n_terms = len(terms) + 1
        self.bound = np.zeros((n_terms, n_blocks))
        np.maximum.at(self.bound, (term, who // BLOCK), weight)
        cell = term[by] * n_blocks + self.who // BLOCK if n_blocks else term[by]
        self.lists = np.searchsorted(cell, np.arange(n_terms * n_blocks + 1))
        self.n_blocks = n_blocks
        self.ids = np.append(self.ids, np.zeros(n_blocks * BLOCK - len(self.ids), np.int64))
        self.said: dict = {}
        self.terms_of: TermsOf | None = None
        self.rows = self.row_of = None
        self.none, self.table = self._calibrated()
        self.rows = self.row_of = None  # not sent to the workers

    def vector(self, bag: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        pairs = sorted((self.at[t], n) for t, n in bag.items() if t in self.at)
        return self._vector(np.array([t for t, _ in pairs], np.int64), np.array([n for _, n in pairs], float))

    def _vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(terms):
            return terms, counts
        weight = np.append((1 + np.log(counts)) * self.idf[terms], REST)
        return np.append(terms, len(self.at)), weight / np.sqrt((weight**2).sum())

    def nearest(self, terms: np.ndarray, weight: np.ndarray, but: int = -1) -> list[tuple[float, int]]:
        """The K nearest examples (similarity, index) with a similarity over 0, nearest first."""
        return self.all_nearest([(terms, weight)], [but])[0]

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[int]) -> list[list[tuple[float, int]]]:
        """nearest() of each of some vectors."""
        out: list[list[tuple[float, int]]] = [[] for _ in vectors]
        wide = []
        for k, (terms, weight) in enumerate(vectors):
            if not len(terms) or not self.n_blocks:
                continue
            bounds = weight @ self.bound[terms]
            order = np.argsort(-bounds, kind="stable")
            scores = np.zeros(self.n_blocks * BLOCK)
            self._add(scores, terms, weight, order[:FIRST])  # the best blocks first: they raise the score to beat
            if but[k] >= 0:
                scores[but[k]] = 0
            some, left = scores[scores > 0], order[FIRST:]
            least = np.partition(some, len(some) - K)[len(some) - K] if len(some) >= K else 0.0
            left = left[(bounds[left] > 0) & (bounds[left] >= least - 1e-8)]
            if len(left) * SPARSE > self.n_blocks:
                wide.append(k)
                continue
            if len(left):
                self._add(scores, terms, weight, left)
            out[k] = self._best(scores, but[k])
        for a in range(0, len(wide), AT_ONCE):
            part = wide[a : a + AT_ONCE]
            for k, scores in zip(part, self._whole([vectors[k] for k in part]), strict=True):
                out[k] = self._best(scores, but[k])
        return out

    def _best(self, scores: np.ndarray, but: int) -> list[tuple[float, int]]:
        if but >= 0:
            scores[but] = 0
        least = np.partition(scores, len(scores) - K)[len(scores) - K] if len(scores) > K else 0.0
        found = np.flatnonzero((scores > 0) & (scores >= least - 1e-8))
        said = np.round(scores[found], 9)
        best = np.lexsort((self.ids[found], -said))[:K]
        return list(zip(said[best].tolist(), found[best].tolist(), strict=True))

    def _add(self, scores: np.ndarray, terms: np.ndarray, weight: np.ndarray, blocks: np.ndarray) -> None:
        """Adds what the lists of some blocks give."""
        cells = (terms[:, None] * self.n_blocks + blocks).ravel()
        self._read(scores, self.lists[cells], self.lists[cells + 1], np.repeat(weight, len(blocks)))

    def _read(self, scores: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> None:
        size = end - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        scores += np.bincount(self.who[at], np.repeat(weight, size) * self.weight[at], len(scores))

    def _whole(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The scores of all examples by whole lists, a row for each vector."""
        if self.rows is None:
            self.rows, self.row_of = self._rows()
        out = np.zeros((len(vectors), len(self.rows)))
        for k, (terms, weight) in enumerate(vectors):
            at = self.row_of[terms]
            out[k, at[at >= 0]] = weight[at >= 0]
        out = out @ self.rows
        for k, (terms, weight) in enumerate(vectors):
            rest = self.row_of[terms] < 0
            self._read(out[k], self.lists[terms[rest] * self.n_blocks], self.lists[(terms[rest] + 1) * self.n_blocks], weight[rest])
        return out

    def _rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest lists with a place for every example, and the row of each term or -1."""
        bounds = self.lists[:: self.n_blocks]
        size = np.diff(bounds)
        longest = [t for t in np.argsort(-size, kind="stable")[:WIDE].tolist() if size[t] * SPARSE > len(self.vectors)]
        rows, row_of = np.zeros((len(longest), self.n_blocks * BLOCK)), np.full(len(size), -1)
        for k, t in enumerate(longest):
            row_of[t] = k
            rows[k, self.who[bounds[t] : bounds[t + 1]]] = self.weight[bounds[t] : bounds[t + 1]]
        return rows, row_of

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in near)
        return sum(s * self.labels[i] for s, i in near) / total

    def _calibrated(self) -> tuple[float, np.ndarray]:
        """The rate among examples without neighbours, and a rising rate for each range of votes."""
        hits, counts, alone = np.zeros(BINS + 1), np.zeros(BINS + 1), [0.0, 0.0]
        near_all = self.all_nearest(self.vectors, list(range(len(self.vectors))))
        for i, v in enumerate(self.vectors):
            if len(v[0]) > 1 and (near := near_all[i]):
                k = int(self.vote(near) * BINS + 1e-6)
                hits[k] += self.labels[i]
                counts[k] += 1
            else:
                alone[0] += self.labels[i]
                alone[1] += 1
        blocks = [[h + (k / BINS), c + 1.0, 1] for k, (h, c) in enumerate(zip(hits, counts, strict=True))]
        merged: list[list[float]] = []
        for b in blocks:
            merged.append(b)
            while len(merged) > 1 and merged[-2][0] / merged[-2][1] > merged[-1][0] / merged[-1][1]:
                last = merged.pop()
                merged[-1] = [x + y for x, y in zip(merged[-1], last, strict=True)]
        return (alone[0] / alone[1] if alone[1] else 0.0), np.concatenate([np.full(int(n), h / c) for h, c, n in merged])

    def score(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """The score of each text and the ids of the nearest examples."""
        self.terms_of = TermsOf(self.at) if self.terms_of is None else self.terms_of
        keys, new = [], {}
        for t in texts:
            found: dict[int, int] = {}
            for w, n in Counter(WORD.findall(t.lower())).items():
                for k in self.terms_of[w]:
                    found[k] = found.get(k, 0) + n
            terms, counts = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), float, len(found))
            order = np.argsort(terms)
            terms, counts = terms[order], counts[order]
            keys.append(key := md5(terms.tobytes() + counts.tobytes()).digest())
            if key not in self.said and key not in new:
                new[key] = self._vector(terms, counts)
        said = {}
        for key, near in zip(new, self.all_nearest(list(new.values()), [-1] * len(new)), strict=True):
            said[key] = (float(self.table[int(self.vote(near) * BINS + 1e-6)]), [int(self.ids[i]) for _, i in near[:3]]) if near else (float(self.none), [])
        out = [said[k] if k in said else self.said[k] for k in keys]
        if len(self.said) > MAX_SAID:
            self.said.clear()
        self.said |= said
        return out


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that may be learnt from."""
    said = labels.where(F.col("toxic").isNotNull() & learns(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    said = cut(said, "labels")
    few = F.broadcast(said) if said.count() <= BROADCAST_ROWS else said
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text().alias("text")).join(few, "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = learning_rows(docs, labels)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(WORD.findall(t.lower()))
                for w in found | {w[:PREFIX] + "-" for w in found if len(w) > PREFIX}:
                    seen.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], names=["term", "no", "yes"])

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    no, yes = totals.get(0, 0), totals.get(1, 0)
    if not no + yes:
        return Model([], [], [], [], [])
    a, b = F.col("yes"), F.col("no")
    gap = a * F.lit(float(no)) - b * F.lit(float(yes))
    chi2 = gap * gap * (no + yes) / (F.lit(float(yes)) * no * (a + b) * (no + yes - a - b))
    counted = rows.select("text", "toxic").mapInArrow(count, "term string, no long, yes long").groupBy("term").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    top = counted.where((a + b >= MIN_DOCS) & (a + b < no + yes)).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "term").collect()
    strength = {r["term"]: r["chi2"] for r in top}
    top = [r for r in top if strength.get(r["term"][:PREFIX] + "-", -1.0) < r["chi2"] or r["term"].endswith("-")]
    idf = [float(np.log((1 + no + yes) / (1 + r["no"] + r["yes"])) + 1) for r in top]
    terms = {r["term"] for r in top}

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [bag(t, terms) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([[*map(str, chain.from_iterable((w, n) for w, n in c.items()))] for c in out], pa.list_(pa.string()))], names=["doc_id", "toxic", "bag"])

    chosen = cut(rows.select("doc_id", "toxic").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES).select("doc_id"), "chosen")
    picked = rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(bags, "doc_id long, toxic int, bag array<string>").collect()
    picked.sort(key=lambda r: r["doc_id"])
    return Model([r["term"] for r in top], idf, [r["doc_id"] for r in picked], [r["toxic"] for r in picked], [dict(zip(r["bag"][::2], map(int, r["bag"][1::2]), strict=True)) for r in picked])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [x for a in range(0, len(texts), 4 * AT_ONCE) for x in shipped.value.score(texts[a : a + 4 * AT_ONCE])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.float64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text().alias("text")).mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
