"""Sharding by histogram sort.

Every document gets a 62-bit key: 40 bits of a hash of its text, then 22 bits of a hash of its
id. Documents with equal texts are therefore neighbours in key order. The splitters between
shards are found by counting, without moving a document: the key range is cut into 1024 equal
probes, exact bytes and rows below each probe are summed across partitions, and every probe
that holds a splitter target or too many rows is cut into 1024 again, until the nearest probe
boundary is within the tolerance. Only the counts of probes reach the driver, 1024 for each splitter and level at most,
however many rows or partitions there are. Then the documents are exchanged once, by cells.

Cells are equal ranges of the first key bits, some four for each shuffle partition, and end at splitters; a cell with
too many rows for a task, which copies of one text make, is cut by all other text bits and bits of the id. Their counts and
first slots are tables that never reach the driver.

Law: `bytes`, sizes near equal. Equal texts stay in one shard wherever the tolerance allows;
a group of copies too large for that is cut by the id part of the key.

Defined results: a null text is empty (size 1, crc32 0). Null ids are ordinary keys. Repeated
rows have equal keys and are ordered arbitrarily among themselves, but each has its own slot.
An empty table gives an empty result. Extra columns are kept by shard_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fill_parts, text

DIGIT = 10
TEXT_BITS, ID_BITS = 40, 22
LEVELS = 6  # 60 of the 62 bits; what is left decides the order only
FAN = 1 << DIGIT


def sort_key() -> Column:
    h = F.shiftrightunsigned(F.xxhash64(text()), 64 - TEXT_BITS)
    i = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), 64 - ID_BITS)
    return F.shiftleft(h, ID_BITS).bitwiseOR(i)


def _digit(key: Column, level: int) -> Column:
    return F.shiftright(key, TEXT_BITS + ID_BITS - DIGIT * (level + 1)).bitwiseAND(FAN - 1)


class Probes:
    """A tree of probes. nodes[k] is the first digit path of node k; child[(k, digit)] the node that refines a probe."""

    def __init__(self) -> None:
        self.paths: list[tuple[int, ...]] = [()]
        self.child: dict[tuple[int, int], int] = {}
        self.counts: dict[tuple[int, int], int] = {}

    def refine(self, node: int, digit: int) -> int:
        self.child[node, digit] = len(self.paths)
        self.paths.append((*self.paths[node], digit))
        return len(self.paths) - 1

    def first_key(self, node: int, digit: int) -> int:
        path = (*self.paths[node], digit)
        return sum(d << (TEXT_BITS + ID_BITS - DIGIT * (k + 1)) for k, d in enumerate(path))

    def leaves(self, node: int = 0):
        """(node, digit) of the probes that hold rows and aren't refined, in key order."""
        for digit in range(FAN):
            if (node, digit) in self.child:
                yield from self.leaves(self.child[node, digit])
            elif (node, digit) in self.counts:
                yield node, digit

    def cell(self, key: Column) -> Column:
        """node * FAN + digit of the finest probe of a key."""
        at, out = F.lit(0), None
        depth = max(map(len, self.paths)) + 1
        down = F.create_map(*[x for (n, d), c in self.child.items() for x in (F.lit(n * FAN + d), F.lit(c))]) if self.child else None
        for level in range(depth):
            here = (at * FAN + _digit(key, level)).cast("int")
            out = here if out is None else F.when(at >= 0, here).otherwise(out)
            at = F.lit(-1) if down is None else F.when(at >= 0, F.coalesce(F.try_element_at(down, here), F.lit(-1))).otherwise(F.lit(-1))
        return out


def _count(digests: DataFrame, probes: Probes, fresh: list[int]) -> None:
    for r in digests.withColumn("cell", probes.cell(F.col("key"))).where(F.shiftright("cell", DIGIT).isin(fresh)).groupBy("cell").agg(F.sum("size").alias("b")).collect():
        probes.counts[divmod(r["cell"], FAN)] = r["b"]


def find_splitters(digests: DataFrame, n_shards: int, tolerance: float) -> list[int]:
    """The first keys of all shards but the first, ascending. digests has key and size."""
    probes, fresh = Probes(), [0]
    while True:
        _count(digests, probes, fresh)
        leaves = list(probes.leaves())
        total = sum(probes.counts[x] for x in leaves)
        ends, split = [], set()
        below, k = 0, 1
        for i, x in enumerate(leaves):
            b = probes.counts[x]
            while k < n_shards and below + b >= (target := total * k / n_shards):
                low, high = target - below, below + b - target
                ends.append(i if low < high else i + 1)
                if min(low, high) > tolerance * total / n_shards:
                    split.add(x)
                k += 1
            below += b
        fresh = [probes.refine(*x) for x in sorted(split) if len(probes.paths[x[0]]) + 1 < LEVELS]
        if not fresh:
            break
        for x in split:
            probes.counts.pop(x) if x in probes.child else None
    return [probes.first_key(*leaves[e]) if e < len(leaves) else 1 << (TEXT_BITS + ID_BITS) for e in ends]


def _placed(keyed: DataFrame, n_cells: int, max_rows: int) -> DataFrame:
    """_shard, _cell, _sub, _first (slot) and whether _cut, of all cells of keyed (_key, _shard): every cell that is no more than max_rows rows
    is one row with _sub 0; others have a row for each text and id bits."""
    plain = cut(keyed.groupBy("_shard", _cell(n_cells).alias("_cell")).count(), "cells")
    before = Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    plain = plain.withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")))
    full = cut(plain.where(F.col("count") > max_rows).select("_shard", "_cell", "_first"), "full-cells")
    parts = keyed.withColumn("_cell", _cell(n_cells)).join(full.select("_shard", "_cell"), ["_shard", "_cell"]).groupBy("_shard", "_cell", _sub().alias("_sub")).count()
    inner = Window.partitionBy("_shard", "_cell").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(full, ["_shard", "_cell"]).withColumn("_first", F.col("_first") + F.coalesce(F.sum("count").over(inner), F.lit(0)))
    whole = plain.where(F.col("count") <= max_rows).withColumn("_sub", F.lit(0).cast("long"))
    return whole.select("_shard", "_cell", "_sub", "_first", F.lit(False).alias("_cut")).unionByName(parts.select("_shard", "_cell", "_sub", "_first", F.lit(True).alias("_cut")))


def _cell(n_cells: int) -> Column:
    return F.shiftright("_key", TEXT_BITS + ID_BITS - n_cells.bit_length())


def _sub() -> Column:
    """The text bits and the first ten id bits of a key, from 1."""
    return F.shiftright("_key", ID_BITS - DIGIT) + 1


def shard_documents(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.005, max_rows: int | None = None) -> DataFrame:
    """docs with size, text_crc32, shard and slot (gapless from 0 in key order within each shard).

    Sizes differ from the mean by about the tolerance, or by one document where that is larger. The exchange is
    one by cells; a cell has at most max_rows rows (a quarter of an even share of each shuffle partition where it
    is not given), but for rows whose text and first ten id bits agree."""
    rows = docs.withColumns({"_key": sort_key(), "size": (F.octet_length(text()) + 1).cast("long"), "text_crc32": F.crc32(text())})
    digests = cut(rows.select(F.col("_key").alias("key"), "size"), "shard-keys")
    n_cells = 4 * fill_parts(docs.sparkSession)
    max_rows = max_rows or digests.count() // n_cells + 1
    shard = lambda key: sum((F.when(key >= k, 1).otherwise(0) for k in splitters), F.lit(0))
    splitters = find_splitters(digests, n_shards, tolerance)
    places = cut(_placed(digests.select(F.col("key").alias("_key"), shard(F.col("key")).alias("_shard")), n_cells, 4 * max_rows), "places")
    full = places.where("_cut").select("_shard", "_cell").distinct().withColumn("_full", F.lit(True))
    celled = rows.withColumns({"_shard": shard(F.col("_key")), "_cell": _cell(n_cells)}).join(full, ["_shard", "_cell"], "left")
    celled = celled.withColumn("_sub", F.when(F.col("_full"), _sub()).otherwise(F.lit(0)).cast("long")).drop("_full")
    order = Window.partitionBy("_shard", "_cell", "_sub").orderBy("_key", "doc_id")
    out = celled.withColumn("_rank", F.row_number().over(order) - 1).join(places.drop("_cut"), ["_shard", "_cell", "_sub"])
    names = [F.col(c) for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    return out.select(*names, "size", "text_crc32", F.col("_shard").alias("shard"), (F.col("_first") + F.col("_rank")).alias("slot"))
