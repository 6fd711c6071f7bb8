"""Token files in bit-plane or byte-plane layout.

A file holds the ids of consecutive documents as fixed-size blocks of little-endian unsigned
32-bit ids. Each block is transposed into 4 byte planes or 32 bit planes, and each plane is
compressed with zstandard on its own: high planes are nearly constant and vanish. Layout:

    b"BPL1" | planes of block 0 | planes of block 1 | ... | index | length of index (8 bytes) | b"BPL1"

The index is zstandard over JSON: ids a block, planes, (ids, offset, sizes of planes) of each
block, and the document table (ids and lengths), so that any document is read by decompressing only
its blocks.

Documents are dealt by ranges of doc_id, one file for each range, so that file order is id order.
Files are written under a name of their own by each attempt of a task and moved into place; the
manifest lists the ones that won. Files and manifest are in the shared folder.

Defined results: null texts are empty and have the end id alone. Null doc_ids come first. Rows that
share a doc_id are ordered by the hash of their text. An empty table gives no files.
"""

from __future__ import annotations

import gc
import io
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fill_parts, scratch_root, text
from .trie_bpe import Known, _worker, byte_alphabet, sliced

MAGIC = b"BPL1"
BLOCK_IDS = 1 << 16
NULL_ID = -(1 << 63)
SLICE_CHARS = 1 << 23  # the more, the fewer times a word is looked up
LETTERS = {byte: letter for letter, byte in byte_alphabet().items()}


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [p.tobytes() for p in planes]
    none = bytes((len(ids) + 7) // 8)  # the upper half of ids under 65,536 has no bits
    return [np.packbits((p >> k) & 1).tobytes() if any_bit else none for p in planes for any_bit in (p.any(),) for k in range(8)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if len(rows) == 32:
        rows = [sum(np.unpackbits(rows[8 * b + k], count=n) << k for k in range(8)).astype(np.uint8) for b in range(4)]
    return np.ascontiguousarray(np.stack(rows).T).reshape(-1).view("<u4")


class Writer:
    def __init__(self, out, bits: bool = True, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.zip = zstandard.ZstdCompressor(level=3)
        self.held: list[np.ndarray] = []
        self.n_held, self.at = 0, len(MAGIC)
        self.blocks: list[tuple[int, int, list[int]]] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            whole = np.concatenate(self.held)
            full = len(whole) - len(whole) % self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(whole[k : k + self.block_ids])
            self.held, self.n_held = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.blocks.append((len(ids), self.at, [len(p) for p in packed]))
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        index = self.zip.compress(json.dumps({"block_ids": self.block_ids, "planes": 32 if self.bits else 4, "blocks": self.blocks, "docs": self.docs, "lengths": self.lengths}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class Reader:
    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, io.SEEK_END)
        end = file.tell()
        file.seek(end - 12)
        tail = file.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<Q", tail[:8])
        file.seek(end - 12 - n)
        self.unzip = zstandard.ZstdDecompressor()
        self.index = json.loads(self.unzip.decompress(file.read(n)))
        self.starts = np.concatenate([[0], np.cumsum(self.index["lengths"], dtype=np.int64)])
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            n, at, sizes = self.index["blocks"][k]
            self.file.seek(at)
            planes = [self.unzip.decompress(self.file.read(s)) for s in sizes]
            self.kept = (k, from_planes(planes, n))
        return self.kept[1]

    def document(self, i: int) -> np.ndarray:
        a, b, size = int(self.starts[i]), int(self.starts[i + 1]), self.index["block_ids"]
        if a == b:
            return np.zeros(0, "<u4")
        return np.concatenate([self.block(k)[max(a - k * size, 0) : b - k * size] for k in range(a // size, (b - 1) // size + 1)])


class _Bytes(dict):
    """What a character becomes in the byte alphabet."""

    def __missing__(self, code: int) -> str:
        self[code] = "".join(map(LETTERS.__getitem__, chr(code).encode()))
        return self[code]


@contextmanager
def collecting_no_garbage() -> Iterator[None]:
    """For code that makes many objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class WordEncoder:
    """The tokenizers library. Where a tokenizer splits at white space and by one pattern, its model alone is asked,
    once for each distinct piece of the chunks between white space; all other tokenizers and texts with unusual
    characters go through the whole library."""

    UNUSUAL = regex.compile(r"[^\x00\x02-\x1b\x20-\u02ff\u2010-\u205e]|<\|")
    STEPS = [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]

    def __init__(self, blob: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(blob)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.chunks, self.pieces = Known(400_000), Known(250_000)
        spec = json.loads(blob)
        steps = [(spec[k] or {}).get(name) or [] for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.pattern = None
        if [[x["type"] for x in s] for s in steps] == self.STEPS and steps[0][1]["pattern"] == {"Regex": r"\s+"} and steps[0][1]["content"] == " " and steps[1][0]["behavior"] == "Removed" and steps[1][0]["invert"] and not steps[1][1]["add_prefix_space"]:
            self.pattern = regex.compile(steps[1][0]["pattern"]["Regex"])
        self.mapped = _Bytes()

    def _unusual(self, t: str) -> bool:
        if t.isascii():
            return "<|" in t or any(c in t for c in "\x01\x1c\x1d\x1e\x1f")
        return self.UNUSUAL.search(t) is not None

    def whole(self, t: str) -> list[int]:
        return self.library.encode(t, add_special_tokens=False).ids

    def _learn(self, fresh: list[str]) -> None:
        plain = [c for c in fresh if c.isalpha()]
        split = {c: self.pattern.findall(c) for c in fresh if not c.isalpha()}
        missing = self.pieces.missing(set(chain(plain, chain.from_iterable(split.values()))))
        tokenize, known = self.model.tokenize, self.pieces.new
        for p in missing:
            known[p] = array("I", [t.id for t in tokenize(p if p.isascii() and p.isprintable() else p.translate(self.mapped))]).tobytes()
        look = known.__getitem__
        self.chunks.new.update(zip(plain, map(look, plain), strict=True))
        self.chunks.new.update((c, b"".join(map(look, ps))) for c, ps in split.items())
        self.pieces.forget_long(missing)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Chunks are numbered by Arrow, and each distinct one is looked up once."""
        usual = [self.pattern is not None and not self._unusual(t) for t in texts]
        chunks = pc.utf8_split_whitespace(pa.array([t.lower() for t, u in zip(texts, usual, strict=True) if u], pa.large_string()))
        numbered = chunks.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        with collecting_no_garbage():
            fresh = self.chunks.missing(distinct)
            self._learn(fresh)
            found = list(map(self.chunks.new.__getitem__, distinct))
            self.chunks.forget_long(fresh)
        ids, size = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = numbered.indices.to_numpy()
        count = size[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        every = ids[np.repeat((np.cumsum(size) - size)[which] - ends[:-1], count) + np.arange(ends[-1])]
        bounds = ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()].tolist()
        parts = iter([every[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        return [next(parts) if u else np.array(self.whole(t), np.uint32) for t, u in zip(texts, usual, strict=True)]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, bits: bool = True) -> DataFrame:
    """Writes the token files and returns their manifest: part, path, n_docs, n_ids, base (ids in earlier files)."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    blob = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text().alias("text")).repartitionByRange(fill_parts(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder, writer, out = _worker(WordEncoder, blob), None, None
        for batch in batches:
            for first, texts in sliced(batch, "text", SLICE_CHARS):
                if writer is None:
                    out = where.open_output_stream(f"{name}.tmp")
                    writer = Writer(out, bits)
                for i, ids in zip(batch.column(0).slice(first, len(texts)).to_pylist(), encoder.encode_all(texts), strict=True):
                    writer.add(NULL_ID if i is None else i, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            where.move(f"{name}.tmp", f"{name}.bpl")
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "path": [f"{folder}/{name.rpartition('/')[2]}.bpl"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([sum(writer.lengths)], pa.int64())})

    files = cut(ranged.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; ids are read block by block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, path = fs.FileSystem.from_uri(row["path"])
                with where.open_input_file(path) as file:
                    r = Reader(file)
                    crcs = [zlib.crc32(r.document(i).tobytes()) for i in range(len(r.index["docs"]))]
                    ids = [None if i == NULL_ID else i for i in r.index["docs"]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(r.starts[:-1] + row["base"], pa.int64()), pa.array(r.index["lengths"], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "base", "part").repartition(fill_parts(manifest.sparkSession), "part").select("path", "base")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
