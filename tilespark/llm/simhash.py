"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: XXH64 of word shingles, bit by bit majority.  Equal fingerprints
collapse to one node first, so a group of copies of any size is one entry.

Candidates: 64 bits are cut into ``max_bits + 2`` blocks; two fingerprints within
``max_bits`` agree on at least two blocks, so each pair of blocks gives a table
whose top nodes are the shared masked patterns (the values of these blocks).
A node's members, few or many, stand in Gray order and form a tree: upper nodes hold
the bits all their members share, a query carries its differences so far down the
tree and drops whole nodes when these exceed the limit; every link comes from this search.  A top node above its share
of a partition is split once more by pairs of sub-blocks in the same way, which
loses no link; there are few such nodes, by a stated bound.  Inside a node only
a spanning forest of the links is kept, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import partitions, stored
from tilespark.llm.components import components
from tilespark.session import bound_arrow_batches, ship_by_value

SEED = 42
FAN_OUT = 16
#: A top node has to have more members than this before it is split again.
SPLIT_FROM = 16_384
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i:i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER_AZ).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1).tolist()
    end = end.tolist()
    last = min(shingle, len(words)) - 1
    view = memoryview(line)
    return majority_bits(np.fromiter((xxh64_intdigest(view[s:e], SEED) for s, e in zip(start, end[last:])), np.uint64,
                                     len(words) - last))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row; fp is the fingerprint as a signed long."""
    ship_by_value("tilespark.llm.simhash")
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                fp = np.array([fingerprint(t.as_py(), shingle) for t in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """Position of a fingerprint in the Gray code's order (as a signed long)."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp


def block_masks(bits: int, base: list[int]) -> list[int]:
    """Masks of every pair of ``bits + 2`` near-equal blocks of the bit positions ``base``."""
    blocks = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(base), bits + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Level(NamedTuple):
    """One level of the trees of all groups: what each node's members share, and what stands below it."""
    mask: np.ndarray
    pattern: np.ndarray
    first: np.ndarray  # its first node on the level below
    size: np.ndarray  # how many follow from there
    last: np.ndarray  # its last member


def tree(x: np.ndarray, group: np.ndarray) -> list[Level]:
    """Levels from the members up to one node per group; ``x`` is in Gray order inside equal ``group`` numbers."""
    place = np.arange(len(x))
    levels = [Level(np.full(len(x), ~np.uint64(0)), x, place, np.ones(len(x), np.int64), place)]
    while True:
        mask, pattern, last = levels[-1].mask, levels[-1].pattern, levels[-1].last
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        if len(levels) > 1 and len(starts) == len(mask):
            return levels
        sizes = np.diff(np.r_[starts, len(mask)])
        first = np.flatnonzero((np.arange(len(mask)) - np.repeat(starts, sizes)) % FAN_OUT == 0)
        size = np.diff(np.r_[first, len(mask)])
        differ = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[first], size), first)
        shared = np.bitwise_and.reduceat(mask, first) & ~differ
        levels.append(Level(shared, pattern[first] & shared, first, size, last[first + size - 1]))
        group = group[first]


def linked(x: np.ndarray, group: np.ndarray, bits: int, chunk: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one group within ``bits``: a search of the group's tree for each member."""
    if not len(x):
        return
    levels = tree(x, group)
    top = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    for q0 in range(0, len(x), chunk):
        query = np.arange(q0, min(len(x), q0 + chunk))
        node = top[query]
        so_far = np.bitwise_count((x[query] ^ levels[-1].pattern[node]) & levels[-1].mask[node])
        for up, below in zip(levels[:0:-1], levels[-2::-1]):
            # a node whose members all stand before the query has its pairs found from the other side
            ok = (so_far <= bits) & (up.last[node] > query)
            query, node, so_far = query[ok], node[ok], so_far[ok]
            size = up.size[node]
            child = np.repeat(up.first[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
            query, so_far, known = np.repeat(query, size), np.repeat(so_far, size), np.repeat(up.mask[node], size)
            # only bits that the upper node did not share add to the differences
            so_far = so_far + np.bitwise_count((x[query] ^ below.pattern[child]) & below.mask[child] & ~known)
            node = child
        ok = (so_far <= bits) & (node > query)
        yield query[ok], node[ok]


class Forest:
    """Union-find over array positions; roots are the smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def forest_of(group: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """Root position of each member: members are linked within ``bits`` inside equal ``group`` numbers."""
    forest = Forest(len(x))
    for a, b in linked(x, group, bits):
        forest.join(a, b)
    return forest.root


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v): a spanning forest of the links within ``max_bits`` among the distinct ``fp`` of ``nodes``."""
    ship_by_value("tilespark.llm.simhash")
    n = partitions(nodes.sparkSession)
    tables = block_masks(max_bits, list(range(64)))

    def masked(masks: list[int], name: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(t).alias(name), F.col("fp").bitwiseAND(F.lit(signed(m))).alias(f"{name}_key"))
                                   for t, m in enumerate(masks)]))

    rows = nodes.select("fp", masked(tables, "top").alias("x")).select("fp", "x.*")
    # at most 4 n top nodes can be above the share
    share = max(SPLIT_FROM, len(tables) * nodes.count() // (4 * n))
    large = (rows.groupBy("top", "top_key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > share)
             .select("top", "top_key", F.lit(True).alias("large")))
    rows = rows.join(F.broadcast(large), ["top", "top_key"], "left")
    subs = F.lit(None)
    for t, m in enumerate(tables):
        free = [b for b in range(64) if not m >> b & 1]
        own = F.array(*[F.struct(F.lit(k).alias("sub"), F.col("fp").bitwiseAND(F.lit(signed(s))).alias("sub_key"))
                        for k, s in enumerate(block_masks(max_bits, free))])
        subs = F.when(F.col("top") == t, own).otherwise(subs)
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_key")))
    rows = (rows.select("fp", "top", "top_key", F.explode(F.when(F.col("large"), subs).otherwise(whole)).alias("x"))
            .select("fp", "top", "top_key", "x.*"))
    keys = ["top", "top_key", "sub", "sub_key"]
    dealt = (rows.repartition(n, *keys).withColumn("rank", gray_rank(F.col("fp")))
             .sortWithinPartitions(*keys, "rank").select(F.col("top").cast("long").alias("top"), "top_key",
                                                         F.col("sub").cast("long").alias("sub"), "sub_key", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # whole groups, the last of which may go on in the next batch

        def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
            if not rows.shape[1]:
                return
            same = (rows[:4, 1:] == rows[:4, :-1]).all(axis=0)
            rows = rows[:, np.r_[False, same] | np.r_[same, False]]  # a node of one member has no links
            if not rows.shape[1]:
                return
            x = np.ascontiguousarray(rows[4])
            root = forest_of(np.cumsum(np.r_[True, (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)]), x.view(np.uint64), max_bits)
            i = np.flatnonzero(root != np.arange(len(x)))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(x[root[i]])], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in b.columns])
            # the last group may go on in the next batch
            last = np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or (held[-1][:4, -1] != rows[:4, -1]).any()):
                yield from emit([*held, rows[:, :cut]])
                held = []
            elif cut:
                yield from emit([rows[:, :cut]])
            held.append(np.ascontiguousarray(rows[:, cut:]))
        yield from emit(held)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed long), ``component_id``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked;
    ``component_id`` is the smallest id reachable over links (null ids are passed
    over; null if there is no other).  Texts without words have fingerprint 0
    and link like any other.  Repeated rows are copies.  Other columns are ignored.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    stars = components(links(nodes, max_bits))
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return (fps.join(named.select("fp", "component_id"), "fp")
            .select(F.col("id").alias(id_col), "fp", "component_id"))


def fingerprint_text(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
