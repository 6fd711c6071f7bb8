"""Byte-level BPE by a prefix-sharing trie.

Distinct pre-tokens are visited in the preorder of their byte trie. Each trie node keeps one
state, the last token of the encoding of its prefix: the encoding of a prefix is the encoding of
a shorter prefix plus that token, which must be the one vocabulary suffix that BPE would not
merge or split differently next to the last token before it. A prefix that many words share is
so worked out once, and a word's tokens are read off by walking its states backwards.

Sorted words give that preorder without building nodes: the path from the root is a stack, cut
back to the common prefix with the word before. Whether a merge would cross the border between two
tokens is read off the merges along their edges, and remembered.

The tokenizer file is read by the driver and shipped by broadcast (a fixed file of a few MB).
Memory of a worker is bounded: texts are taken in slices, and of the words known only those asked
for again stay when the table is full.

Defined results: null texts are empty; an empty text has no ids and decodes to an empty text.
Repeated rows and null ids are kept, as are other columns.
"""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters outside are cut into words by the tokenizers library itself; inside, this pattern agrees with it.
UNUSUAL = regex.compile(r"[^\x00-˿‐-⁞]")
# Fixed value: the public pattern of byte-level BPE.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
RUNS = regex.compile(r"\s\s|\s\Z")
MAX_KNOWN = 300_000
MAX_KNOWN_CHARS = 64
SLICE_CHARS = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def chunk_words(chunk: str) -> list[str]:
    """PATTERN.findall for a chunk; the commonest forms are told without the pattern."""
    word = chunk[1:] if chunk[:1] == " " else chunk
    if word.isalpha():
        return [chunk]
    if word[-1:] in ",.;:!?" and word[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return PATTERN.findall(chunk)


class Known:
    """Encodings by string, in two generations: what is asked for again outlives what isn't."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: Iterable[str]) -> list[str]:
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for w in wanted:
            if w not in new:
                if (ids := old.get(w)) is None:
                    out.append(w)
                else:
                    new[w] = ids
        return out

    def forget_long(self, wanted: Iterable[str]) -> None:
        for w in wanted:
            if len(w) > MAX_KNOWN_CHARS:
                self.new.pop(w, None)


class TrieBpe:
    def __init__(self, blob: str) -> None:
        spec = json.loads(blob)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: raw(s) for s, i in spec["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(self.id_of[raw(a)], self.id_of[raw(b)]): (k, self.id_of[raw(a + b)]) for k, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.ends: dict = {}
        for b, i in self.id_of.items():
            node = self.ends
            for byte in reversed(b):
                node = node.setdefault(byte, {})
            node[-1] = i
        self.made = {i: (k, *pair) for pair, (k, i) in reversed(self.rank.items())}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.wholes: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.chunks, self.atoms = Known(MAX_KNOWN), Known(MAX_KNOWN)
        self.blob, self.library = blob, None

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE of a short string."""
        ids = [self.id_of[bytes([b])] for b in data]
        while True:
            best = min((self.rank.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:], strict=False)), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return ids
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a token's right (1) or left (0) edge while it is merged, from the
        byte up, each with the rank of the merge that takes it up."""
        if (steps := self.edges[side].get(token)) is None:
            steps, at, taken = [], token, 1 << 60
            while True:
                steps.append((at, taken))
                if at not in self.made:
                    break
                taken, *halves = self.made[at]
                at = halves[side]
            steps = self.edges[side][token] = steps[::-1]
        return steps

    def whole(self, token: int) -> bool:
        """Are a token's own bytes encoded as that token?"""
        if (said := self.wholes.get(token)) is None:
            said = self.wholes[token] = self.merged(self.bytes_of[token]) == [token]
        return said

    def follows(self, before: int, token: int) -> bool:
        """May token follow before (-1: nothing)? It may not where some merge would cross the border."""
        if not self.whole(token):
            return False
        if before < 0:
            return True
        left, right, i, k = self._edge(before, 1), self._edge(token, 0), 0, 0
        while True:
            (a, a_taken), (b, b_taken) = left[i], right[k]
            rank = self.rank.get((a, b), (1 << 60,))[0]
            if rank < a_taken and rank <= b_taken and rank < 1 << 60:
                return False
            if a_taken == b_taken == 1 << 60:
                return True
            if a_taken <= b_taken:
                i += 1
            else:
                k += 1

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encodes distinct words in the preorder of their trie."""
        out, last, size, before = {}, [-1], [0], b""
        ends, fits = self.ends, self.fits
        for data, word in sorted((w.encode(), w) for w in words):
            keep, most = 0, min(len(before), len(data))
            while keep < most and before[keep] == data[keep]:
                keep += 1
            del last[keep + 1 :], size[keep + 1 :]
            for i in range(keep + 1, len(data) + 1):
                node, at, found = ends, i, []
                while at and (node := node.get(data[at - 1])) is not None:
                    at -= 1
                    if (token := node.get(-1)) is not None:
                        found.append(token)
                        found.append(i - at)
                while found:
                    n, token = found.pop(), found.pop()
                    if (ok := fits.get((last[i - n] << 20) + token)) is None:
                        ok = fits[(last[i - n] << 20) + token] = self.follows(last[i - n], token)
                    if ok:
                        last.append(token)
                        size.append(n)
                        break
                else:
                    raise ValueError(f"no token ends {data[:i]!r}")
            ids, at = [], len(data)
            while at:
                ids.append(last[at])
                at -= size[at]
            out[word] = array("i", reversed(ids)).tobytes()
            before = data
        return out

    def _pieces(self, text: str) -> tuple[str, list[str]]:
        """How to look a text up: as chunks that each begin at a space, whose words don't depend on
        each other, or word by word where white space or characters are unusual."""
        if UNUSUAL.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.blob)
            return "atoms", [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if RUNS.search(text) or "\0" in text:
            return "atoms", PATTERN.findall(text)
        return "chunks", text.replace(" ", "\0 ").split("\0")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [[("special", [s]) if s in self.special else self._pieces(s) for s in (self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t]) if s] for t in texts]
        chunks = {c for parts in cut for kind, p in parts if kind == "chunks" for c in p}
        atoms = {w for parts in cut for kind, p in parts if kind == "atoms" for w in p}
        fresh = {c: chunk_words(c) for c in self.chunks.missing(chunks)}
        atoms.update(chain.from_iterable(fresh.values()))
        if len(self.fits) > 4 * MAX_KNOWN:
            self.fits = {}
        self.atoms.new |= self.learn(self.atoms.missing(atoms))
        atom = self.atoms.new.__getitem__
        self.chunks.new |= {c: b"".join(map(atom, ws)) for c, ws in fresh.items()}
        look = {"atoms": atom, "chunks": self.chunks.new.__getitem__, "special": lambda s: array("i", [self.special[s]]).tobytes()}
        out = [np.frombuffer(b"".join(chain.from_iterable(map(look[kind], p) for kind, p in parts)), np.int32) for parts in cut]
        self.chunks.forget_long(chunks)
        self.atoms.forget_long(atoms)
        return out


class Decoder:
    """Token ids to text; bytes that are no UTF-8 become replacement characters."""

    def __init__(self, blob: str) -> None:
        spec = json.loads(blob)
        letters = byte_alphabet()
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        self.bytes_of |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}

    def decode(self, ids: list[int]) -> str:
        return decode_ids(self.bytes_of, ids)


def decode_ids(bytes_of: dict[int, bytes], ids: list[int]) -> str:
    return b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict = {}


def _worker(kind, blob):
    """One table per Python worker."""
    if (k := (kind, hash(blob.value))) not in _LOADED:
        _LOADED.clear()
        _LOADED[k] = kind(blob.value)
        gc.freeze()  # the tables stay; walking them over and over finds nothing
    return _LOADED[k]


def sliced(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch, about chars at a time."""
    texts, start, held = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= chars or i + 1 == batch.num_rows:
            yield start, texts
            texts, start, held = [], i + 1, 0


def mapped(df: DataFrame, column: str, field: T.StructField, kind: pa.DataType, make: Callable[[list], pa.Array], drop: bool = False) -> DataFrame:
    """df with one more column, made by make() from lists of texts, in Arrow batches."""
    df = df.drop(field.name) if field.name != column else df
    schema = T.StructType([f for f in df.schema.fields if not (drop and f.name == column)] + [field])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in sliced(batch, column):
                part = batch.slice(start, len(texts))
                cols = [c for n, c in zip(part.schema.names, part.columns, strict=True) if not (drop and n == column)]
                yield pa.RecordBatch.from_arrays([*cols, make(texts)], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def encode(docs: DataFrame, tokenizer_path: str, column: str = "text", drop: bool = False) -> DataFrame:
    """docs with ids, the token ids of column."""
    blob = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    return mapped(docs, column, T.StructField("ids", T.ArrayType(T.IntegerType())), pa.list_(pa.int32()), lambda texts: _lists(_worker(TrieBpe, blob).encode_all(texts)), drop)


def decode(df: DataFrame, tokenizer_path: str, column: str = "ids") -> DataFrame:
    """df with decoded, the text of the ids in column."""
    blob = df.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(column)
            ids = batch.column(at)
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            bpe = _worker(Decoder, blob)
            texts = [bpe.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, column: str = "text") -> DataFrame:
    """docs without column, with ids and decoded: encode and decode in one pass and one worker."""
    blob = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    rest = [f for f in docs.schema.fields if f.name not in (column, "ids", "decoded")]
    schema = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(TrieBpe, blob)
        for batch in batches:
            kept = batch.select([f.name for f in rest])
            for start, texts in sliced(batch, column):
                ids = bpe.encode_all(texts)
                texts.clear()
                decoded = pa.array([decode_ids(bpe.bytes_of, i.tolist()) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*kept.slice(start, len(ids)).columns, _lists(ids), decoded], names=[f.name for f in schema.fields])

    return docs.select(*[f.name for f in rest], column).mapInArrow(run, schema)
