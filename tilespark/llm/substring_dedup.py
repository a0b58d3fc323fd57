"""Suffix-array dedup: removes bytes of passages that an earlier document has.

Only suffixes that can matter are sorted.  Every string of ``match`` bytes has an
anchor: the least hash of the ``GRAM``-byte strings in it (leftmost on a tie), a
rule that depends on its bytes alone, so equal strings have equal anchors at
equal places.  Neighbouring strings with one anchor form a run, and a run's
context is its bytes.  Two equal strings are in runs with the same anchor hash.

1. Documents are packed into slices, stored bucketed by slice number, so that
   later rounds join small answers to them without shuffling texts.
2. Each slice sends, per distinct (anchor, context) it holds, a code, a digest of
   the context, and the least document.  Copies inside a slice collapse here, and
   an anchor with many contexts in a slice sends one entry, so no anchor brings
   more than ``CONTEXTS`` entries from a slice.
3. Anchors with one context everywhere are answered with the least document.
   For anchors with several, the contexts themselves go to a sort: all suffixes
   of the contexts are ordered by multikey quicksort, eight bytes a character, to
   a shallow depth, and groups still tied are put in order by blind tries; equal
   neighbours give each string's least document.  Anchors above their share of a
   partition are split into their strings instead, grouped by Spark.
4. Each slice marks the strings whose least document is smaller than theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import partitions, stored
from tilespark.llm.slices import (LAST, from_low_bytes, loaded, low_bytes, pack_slices, packed_ascending,
                                  unpacked_ascending)
from tilespark.session import bound_arrow_batches, ship_by_value

MATCH, GRAM = 50, 24
SHALLOW = 32
SLICE_BYTES = 2 << 20
PIECE = 1 << 15  # strings looked at together; their hashes stay in a core's cache
CONTEXTS = 8
HASH_BITS = 56  # of an anchor; the low 8 bits of a word hold its place in the string
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def words_at(data: np.ndarray, first: int, count: int) -> np.ndarray:
    """The eight bytes at each of ``count`` neighbouring places, as little-endian numbers."""
    return np.ndarray((count,), "<u8", buffer=data, offset=first, strides=(1,))


class Runs(NamedTuple):
    start: np.ndarray  # of the run's first string
    width: np.ndarray  # number of strings
    anchor: np.ndarray  # hash of HASH_BITS bits


def runs(data: np.ndarray, ends: np.ndarray, match: int = MATCH) -> Runs:
    """Runs of strings with one anchor; strings stay inside documents."""
    width, n = match - GRAM + 1, len(data)
    m1, m2, m3, m4 = (np.uint64(x) for x in MULTIPLIERS)
    found = []
    begins = np.r_[0, ends[:-1]]
    for a in range(0, max(0, n - match + 1), PIECE):
        b = min(n - match + 1, a + PIECE)
        count = b - a + width - 1
        h = words_at(data, a, count) * m1
        h += words_at(data, a + 8, count) * m2
        h ^= words_at(data, a + 16, count) * m3
        h ^= h >> np.uint64(29)
        h *= m4
        h &= np.uint64((1 << 64) - 256)
        span = 1  # h[i]: least of ``span`` hashes from i on, its offset in the low bits
        while span * 2 <= width:
            h = np.minimum(h[:-span], h[span:] + np.uint64(span))
            span *= 2
        if width > span:
            h = np.minimum(h[:span - width], h[width - span:] + np.uint64(width - span))
        at = np.arange(a, b) + (h & np.uint64(255)).astype(np.int64)
        # no string begins in the last match - 1 bytes of a document
        near = slice(np.searchsorted(ends, a, "right"), np.searchsorted(ends, b + match, "right") + 1)
        low, high = np.maximum(begins[near], ends[near] - match + 1), ends[near]
        for x, y in zip((np.clip(low, a, b) - a).tolist(), (np.clip(high, a, b) - a).tolist()):
            at[x:y] = -1
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size = np.diff(np.r_[first, b - a])
        real = at[first] >= 0
        first, size = first[real], size[real]
        # anchors are least hashes, so they are mixed again before they deal out work
        mixed = (h[first] >> np.uint64(8)) * m2
        found.append((first + a, size, mixed & np.uint64((1 << HASH_BITS) - 1)))
    if not found:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Runs(*map(np.concatenate, zip(*found)))


def digests(data: np.ndarray, start: np.ndarray, size: np.ndarray, match: int) -> np.ndarray:
    """32-bit digests of the contexts data[start:start + size], match <= size < 2 * match."""
    out = size.astype(np.uint64) * np.uint64(MULTIPLIERS[0])
    if not len(start):
        return out.astype(np.uint32)
    view = words_at(data, 0, len(data) - 7)
    end = start + size - 8
    for k in range(0, match - 7, 8):  # from the front, then back from the end over the rest
        out = (out ^ view[start + k]) * np.uint64(MULTIPLIERS[1])
        out ^= out >> np.uint64(31)
    for k in range(0, match - GRAM + 8, 8):
        out = (out ^ view[np.maximum(end - k, start)]) * np.uint64(MULTIPLIERS[2])
        out ^= out >> np.uint64(31)
    return (out * np.uint64(MULTIPLIERS[3]) >> np.uint64(32)).astype(np.uint32)


class Entries(NamedTuple):
    """A slice's distinct (anchor, context) pairs in the order of their anchors."""
    runs: Runs
    doc: np.ndarray  # of each run
    entry: np.ndarray  # of each run
    first_run: np.ndarray  # of each entry
    anchor: np.ndarray
    digest: np.ndarray
    least: np.ndarray  # smallest id among the entry's documents
    rich: np.ndarray  # more than CONTEXTS entries of one anchor
    sent: np.ndarray  # entries sent, ordered by bucket, then id
    bucket: np.ndarray  # of each sent entry


def entries(ids: np.ndarray, ends: np.ndarray, data: np.ndarray, n_buckets: int, match: int) -> Entries:
    r = runs(data, ends, match)
    doc = np.searchsorted(ends, r.start, "right")
    digest = digests(data, r.start, r.width + match - 1, match)
    order = np.argsort(r.anchor)
    a = r.anchor[order]
    # only runs that share an anchor need an order among them, the same on every machine
    shared = np.flatnonzero(np.r_[False, a[1:] == a[:-1]] | np.r_[a[1:] == a[:-1], False]) if len(a) else order
    tied = order[shared]
    order[shared] = tied[np.lexsort((tied, digest[tied], r.anchor[tied]))]
    d = digest[order]
    new_anchor = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    new = new_anchor | np.r_[True, d[1:] != d[:-1]] if len(a) else new_anchor
    head = np.flatnonzero(new)
    entry = np.empty(len(a), np.int64)
    entry[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[doc[order]], head) if len(head) else np.zeros(0, np.int64)
    group = np.cumsum(new_anchor[head]) - 1
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    rich = size[group] > CONTEXTS if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(new_anchor[head])
    # a rich anchor sends its first entry only
    sent = np.flatnonzero(~rich | np.isin(np.arange(len(head)), first))
    bucket = ((a[head][sent] >> np.uint64(HASH_BITS - 32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    by = np.lexsort((least[sent], bucket))
    return Entries(r, doc, entry, order[head], a[head], d[head], least, rich, sent[by], bucket[by])


CODE_BYTES = 5
RICH = 0xFFFFFFFF


def entry_rows(e: Entries) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, codes, digests, ids) of the sent entries."""
    edge = np.flatnonzero(np.r_[True, e.bucket[1:] != e.bucket[:-1], True]) if len(e.bucket) else np.zeros(1, np.int64)
    for lo, hi in zip(edge[:-1], edge[1:]):
        x = e.sent[lo:hi]
        digest = np.where(e.rich[x], np.uint32(RICH), np.minimum(e.digest[x], np.uint32(RICH - 1)))
        yield int(e.bucket[lo]), low_bytes(e.anchor[x], CODE_BYTES), digest.astype("<u4").tobytes(), packed_ascending(e.least[x])


def answers(codes: np.ndarray, digest: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a bucket: the least id (its own included) and whether its anchor has several contexts."""
    order = np.lexsort((digest, codes))
    c, d = codes[order], digest[order]
    new = np.r_[True, c[1:] != c[:-1]]
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    several = np.logical_or.reduceat(np.r_[False, (d[1:] != d[:-1])] & ~new | (d == RICH), head)[group]
    least, several_out = np.empty_like(ids), np.empty(len(ids), bool)
    least[order] = np.minimum.reduceat(ids[order], head)[group]
    several_out[order] = several
    return least, several_out


class BlindTrie:
    """Strings of one length in order: a node holds the place where its strings first
    differ, a descent looks at these places only, and one comparison with the leaf
    found tells where the new string belongs."""

    def __init__(self, key: bytes, member: int):
        self.root = (None, key, [member])

    def insert(self, key: bytes, member: int) -> None:
        node = self.root
        while node[0] is not None:
            node = node[1].get(key[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == key:
            node[2].append(member)
            return
        size = len(key)
        differ = int.from_bytes(key, "big") ^ int.from_bytes(other, "big")
        place = size - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] is not None and node[0] < place:
            above, node = node, node[1][key[node[0]]]
        leaf = (None, key, [member])
        if node[0] == place:
            node[1][key[place]] = leaf
            return
        fresh = (place, {other[place]: node, key[place]: leaf})
        if above is None:
            self.root = fresh
        else:
            above[1][key[above[0]]] = fresh

    def ordered(self) -> Iterator[list[int]]:
        """Members of equal strings, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def sorted_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort of the strings data[start:start + match] inside each ``group``:
    the order, and where in it a string differs from the one before."""
    order = np.argsort(group, kind="stable")
    fresh = np.r_[True, np.diff(group[order]) != 0]
    view = words_at(data, 0, len(data) - 7)
    for depth in range(0, min(SHALLOW, match - 7), 8):
        number = np.cumsum(fresh)
        tied = np.flatnonzero(~fresh | ~np.r_[fresh[1:], True])
        if not len(tied):
            return order, fresh
        word = view[start[order[tied]] + depth].byteswap()
        by = np.lexsort((word, number[tied]))
        order[tied] = order[tied][by]
        word = word[by]
        fresh[tied] |= np.r_[True, word[1:] != word[:-1]]
    done = min(SHALLOW, (match - 7 + 7) // 8 * 8)
    head = np.flatnonzero(fresh)
    size = np.diff(np.r_[head, len(fresh)])
    # a group of one string has its order already
    differ = np.zeros(len(order), bool)
    tied = np.flatnonzero(np.repeat(size > 1, size))
    place, first = start[order[tied]], start[order[np.repeat(head, size)[tied]]]
    for depth in [*range(done, match - 7, 8), match - 8]:
        differ[tied] |= view[place + depth] != view[first + depth]
    several = np.logical_or.reduceat(differ, head) if len(head) else differ
    raw = data.tobytes()
    for h, n in zip(head[several].tolist(), size[several].tolist()):
        at = order[h:h + n].tolist()
        where = start[order[h:h + n]].tolist()
        trie = BlindTrie(raw[where[0] + done:where[0] + match], at[0])
        for member, w in zip(at[1:], where[1:]):
            trie.insert(raw[w + done:w + match], member)
        k = h
        for members in trie.ordered():
            order[k:k + len(members)] = members
            fresh[k + 1:k + len(members)] = False
            fresh[k] = True
            k += len(members)
    return order, fresh


def least_of_strings(contexts: list[bytes], group: list[int], least: list[int], match: int) -> list[np.ndarray]:
    """For each context, the least id over all equal strings of its group, string by string."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    width = size - match + 1
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    offset = np.cumsum(size) - size
    first = np.cumsum(width) - width
    start = np.repeat(offset - first, width) + np.arange(width.sum())
    order, fresh = sorted_groups(data, start, np.repeat(np.array(group), width), match)
    ids = np.repeat(np.array(least, np.int64), width)
    head = np.flatnonzero(fresh)
    out = np.empty_like(ids)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], head), np.diff(np.r_[head, len(order)]))
    return np.split(out, first[1:])


def decoded(e: Entries, found: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Least id and "has several contexts" of each entry, from the slice's answers."""
    least, several = e.least.copy(), e.rich.copy()
    at = dict(zip(*(x.tolist() for x in np.unique(e.bucket, return_index=True))))
    for a in found or ():
        n = a["n"]
        x = e.sent[at[a["bucket"]]:at[a["bucket"]] + n]
        smaller = np.unpackbits(np.frombuffer(a["smaller"], np.uint8), count=n).astype(bool)
        least[x[smaller]] = np.frombuffer(a["least"], "<i8")
        several[x] |= np.unpackbits(np.frombuffer(a["several"], np.uint8), count=n).astype(bool)
    return least, several


def substring_dedup(docs: DataFrame, match: int = MATCH, id_col: str = "doc_id", text_col: str = "text",
                    split_from: int = 1 << 13) -> DataFrame:
    """One row per row: id, ``n_bytes``, ``removed`` (maximal removed byte runs, half-open), ``kept`` (binary).

    A byte goes if a string of ``match`` bytes around it also starts in a document
    with a smaller id; all is judged on the input.  Ids are integers; a null id
    ranks last.  Rows that repeat an id, and rows without one, take nothing from
    each other.  A null text counts as empty.  Other columns are ignored.  Anchors
    with more than ``split_from`` contexts, and above their share, are split.
    """
    if not 40 <= match <= 200:
        raise ValueError("match must be between 40 and 200 bytes")
    ship_by_value("tilespark.llm.substring_dedup", "tilespark.llm.slices")
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    n = partitions(spark)
    slices = pack_slices(docs, id_col, text_col, n, slice_bytes=SLICE_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                e = entries(*loaded(b["ids"][row].as_py(), b["ends"][row].as_py(), b["data"][row].as_buffer()), n, match)
                out = list(entry_rows(e))
                if out:
                    bucket, code, digest, ids = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket, pa.int32()), pa.array([b["slice"][row].as_py()] * len(out), pa.int64()),
                         *(pa.array(x, pa.binary()) for x in (code, digest, ids))], ["bucket", "slice", "codes", "digests", "ids"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: r[0])
        k = 0
        while k < len(rows):
            to = k
            while to < len(rows) and rows[to][0] == rows[k][0]:
                to += 1
            part = rows[k:to]
            k = to
            codes = np.concatenate([from_low_bytes(r[2], CODE_BYTES) for r in part])
            digest = np.concatenate([np.frombuffer(r[3], "<u4") for r in part])
            ids = np.concatenate([unpacked_ascending(r[4]) for r in part])
            least, several = answers(codes, digest, ids)
            smaller = (least < ids) & ~several
            at = 0
            out = []
            for r in part:
                m = len(r[3]) // 4
                s, v = smaller[at:at + m], several[at:at + m]
                if s.any() or v.any():
                    out.append((r[1], r[0], m, np.packbits(s).tobytes(), least[at:at + m][s].astype("<i8").tobytes(), np.packbits(v).tobytes()))
                at += m
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                                 ["slice", "bucket", "n", "smaller", "least", "several"])

    sent = slices.mapInArrow(send, "bucket int, slice long, codes binary, digests binary, ids binary")
    found = stored(sent.repartitionById(n, "bucket")
                   .mapInArrow(answer, "slice long, bucket int, n int, smaller binary, least binary, several binary"), "anchors")
    by_slice = found.groupBy("slice").agg(F.collect_list(F.struct("bucket", "n", "smaller", "least", "several")).alias("found"))
    known = slices.join(by_slice, "slice", "left").select("slice", "ids", "ends", "data", "found")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                e = entries(*loaded(b["ids"][row].as_py(), b["ends"][row].as_py(), b["data"][row].as_buffer()), n, match)
                x = np.flatnonzero(decoded(e, b["found"][row].as_py())[1])
                raw = b["data"][row].as_buffer()
                start = e.runs.start[e.first_run[x]]
                end = start + e.runs.width[e.first_run[x]] + match - 1
                for i in range(0, len(x), 20_000):
                    part = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(e.anchor[x[part]].astype(np.int64)),
                         pa.array([raw[s:t].to_pybytes() for s, t in zip(start[part].tolist(), end[part].tolist())], pa.binary()),
                         pa.array(e.least[x[part]]), pa.array(np.full(len(x[part]), b["slice"][row].as_py())), pa.array(x[part])],
                        ["anchor", "context", "least", "slice", "entry"])

    several = stored(known.mapInArrow(contexts, "anchor long, context binary, least long, slice long, entry long"), "contexts")
    share = max(split_from, several.count() // (4 * n))
    # at most 4 n anchors can be above the share
    heavy = (several.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > share)
             .select("anchor", F.lit(True).alias("heavy")))
    any_heavy = not heavy.isEmpty()
    marked = several.join(F.broadcast(heavy), "anchor", "left")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Rows of whole anchors, sorted by (anchor, context)."""
            texts, group, least, member, lone = [], [], [], [], []
            for anchor, context, low, slice_, entry in rows:
                if not group or group[-1] != anchor or texts[-1] != context:
                    texts.append(context), group.append(anchor), least.append(low), member.append([])
                least[-1] = min(least[-1], low)
                member[-1].append((slice_, entry))
            number = np.cumsum(np.r_[True, np.diff(np.array(group, np.int64)) != 0])
            lone = (np.bincount(number) == 1)[number]
            mins: list = [None] * len(texts)
            rest = np.flatnonzero(~lone).tolist()
            if rest:
                for k, x in zip(rest, least_of_strings([texts[k] for k in rest], number[rest].tolist(), [least[k] for k in rest], match)):
                    mins[k] = x[:1] if (x == x[0]).all() else x
            out = [(s, e, mins[k] if mins[k] is not None else [least[k]]) for k in range(len(texts)) for s, e in member[k]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                                              pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["slice", "entry", "least"])

        for b in batches:
            for i in range(0, b.num_rows, 4096):
                held += zip(*(c.to_pylist() for c in b.slice(i, 4096).columns))
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield from done(held[:cut])
                    held = held[cut:]
        if held:
            yield from done(held)

    answer_schema = "slice long, entry long, least array<long>"
    light = (marked.where("heavy IS NULL").select("anchor", "context", "least", "slice", "entry")
             .repartition(n, "anchor").sortWithinPartitions("anchor", "context").mapInArrow(order, answer_schema))
    strings = (marked.where("heavy").select("slice", "entry", "context", "least")
               .select("slice", "entry", "least", "context", F.explode(F.sequence(F.lit(1), F.octet_length("context") - match + 1)).alias("i"))
               .select("slice", "entry", "least", "i", F.expr(f"substring(context, i, {match})").alias("string")))
    if any_heavy:
        # stored: as a side of its own, the join can split a hot string
        first = stored(strings.groupBy("string").agg(F.min("least").alias("first")), "first-strings")
        light = light.unionByName(
            strings.select("slice", "entry", "i", "string").join(first, "string").groupBy("slice", "entry")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "first"))), lambda x: x["first"]).alias("least")))
    ordered = stored(light, "strings")
    by_entry = ordered.groupBy("slice").agg(F.collect_list(F.struct("entry", "least")).alias("strings"))
    final = (known.join(by_entry, "slice", "left").select("ids", "ends", "data", "found", "strings"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, ends, data = loaded(b["ids"][row].as_py(), b["ends"][row].as_py(), b["data"][row].as_buffer())
                e = entries(ids, ends, data, n, match)
                least, several = decoded(e, b["found"][row].as_py())
                again = np.zeros(len(data) + match + 1, np.int32)  # changes of "a string that begins here is known"
                own = ids[e.doc]
                whole = np.flatnonzero(~several[e.entry] & (least[e.entry] < own))
                np.add.at(again, e.runs.start[whole], 1)
                np.add.at(again, e.runs.start[whole] + e.runs.width[whole], -1)
                begins = np.cumsum(again) > 0
                part = np.flatnonzero(several[e.entry])
                if len(part):
                    col = b["strings"][row].values  # a struct array of (entry, least)
                    which, lists = col.field("entry").to_numpy(), col.field("least")
                    flat, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                    offset = np.zeros(len(e.least), np.int64)
                    size = np.zeros(len(e.least), np.int64)
                    offset[which], size[which] = np.cumsum(count) - count, count
                    width, entry = e.runs.width[part], e.entry[part]
                    k = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                    value = flat[np.repeat(offset[entry], width) + np.where(np.repeat(size[entry], width) == 1, 0, k)]
                    smaller = value < np.repeat(own[part], width)
                    begins[(np.repeat(e.runs.start[part], width) + k)[smaller]] = True
                total = np.cumsum(np.r_[0, begins])
                place = np.arange(1, len(data) + 1)
                gone = total[place] > total[np.maximum(0, place - match)]
                edge = np.zeros(len(data) + 1, bool)
                edge[np.r_[0, ends]] = True
                # a removed run begins or ends where removal changes, or at a document's edge inside it
                flag = np.r_[False, gone, False]
                starts = np.flatnonzero(flag[1:-1] & (~flag[:-2] | edge[:-1]))
                stops = np.flatnonzero(flag[1:-1] & (~flag[2:] | edge[1:])) + 1
                of = np.searchsorted(ends, starts, "right")
                begin = np.r_[0, ends[:-1]]
                kept = data[~gone]
                cut = np.cumsum(np.r_[0, ~gone])[ends]
                cuts = np.r_[0, cut]
                counts = np.bincount(of, minlength=len(ids))
                spans = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(counts)], pa.int32()),
                    pa.StructArray.from_arrays([pa.array(starts - begin[of]), pa.array(stops - begin[of])], ["start", "end"]))
                raw = kept.tobytes()
                step = 512
                for i in range(0, len(ids), step):
                    j = min(len(ids), i + step)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if x == LAST else x for x in ids[i:j].tolist()], pa.int64()), pa.array((ends - begin)[i:j]),
                         spans.slice(i, j - i), pa.array([raw[s:t] for s, t in zip(cuts[i:j].tolist(), cuts[i + 1:j + 1].tolist())], pa.binary())],
                        ["id", "n_bytes", "removed", "kept"])

    return (final.mapInArrow(finish, "id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
            .withColumnRenamed("id", id_col))
