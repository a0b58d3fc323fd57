"""Benchmark decontamination with an FM-index per training shard.

The test phrases are a stated query set: they are streamed through the driver in
blocks of at most ``block_words`` words, and each block (a bounded broadcast)
meets all documents in one map without a shuffle.  A shard is a run of documents
inside a task.  Its index covers the shard's runs of benchmark words that are at
least as long as the shortest phrase; a word that no phrase has, or a shorter
run, cannot be part of an occurrence.  Phrases are searched backwards, all at
once, and occurrences are located and merged into removal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import stored
from tilespark.llm.fm_index import FMIndex
from tilespark.session import bound_arrow_batches, ship_by_value

NGRAM = 10
BLOCK_WORDS = 1_000_000
SHARD_SYMBOLS, SHARD_DOCS = 1 << 20, 4096
PART_BYTES = 4 << 20

#: Word bytes are 0-9, a-z and all above 0x7F, after A-Z are lower-cased; all others separate words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    data = (text or "").encode().translate(TO_WORDS)
    at = 0
    while at < len(data):
        to = len(data) if at + PART_BYTES >= len(data) else data.find(b" ", at + PART_BYTES)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


class Block:
    """Phrases of some benchmark items: vocabulary, phrase symbols by length, and the items of each phrase."""

    def __init__(self, items: list[tuple[str, list[bytes]]], ngram: int):
        self.vocabulary: dict[bytes, int] = {}
        phrases: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(ngram, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners = phrases.setdefault(size, {}).setdefault(tuple(ids[i:i + size]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.phrases = {n: (np.array(list(p), np.int64), list(p.values())) for n, p in phrases.items()}
        self.least = min(self.phrases, default=0)


class Shard:
    """Collects the documents of a shard; ``hits`` builds the index and looks all phrases up."""

    def __init__(self, block: Block):
        self.block, self.docs, self.size = block, 0, 0
        self.symbols: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.word: list[np.ndarray] = []

    def add(self, ids: np.ndarray, doc: np.ndarray, word: np.ndarray) -> None:
        """``ids`` of consecutive words (0: outside the vocabulary, or between documents)."""
        edge = np.diff(np.r_[0, (ids > 0).astype(np.int8), 0])
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long_ = end - start >= self.block.least
        start, end = start[long_], end[long_]
        if len(start):
            size = end - start + 1  # and the separator
            first = np.cumsum(size) - size
            take = np.repeat(start - first, size) + np.arange(size.sum())
            last = first + size - 1
            symbols = ids[np.minimum(take, len(ids) - 1)]
            symbols[last] = 0
            take = np.minimum(take, len(ids) - 1)
            self.symbols.append(symbols), self.owner.append(doc[take]), self.word.append(word[take])
            self.size += len(symbols)

    def hits(self) -> Iterator[tuple[int, int, int, list[str]]]:
        """(document, first word, length, items) of each occurrence."""
        if not self.size:
            return
        symbols, owner, word = map(np.concatenate, (self.symbols, self.owner, self.word))
        index = FMIndex(symbols, len(self.block.vocabulary))
        for size, (phrases, items) in self.block.phrases.items():
            low, high = index.search(phrases)
            found = np.flatnonzero(high > low)
            count = high[found] - low[found]
            rows = np.repeat(low[found] - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = index.locate(rows)
            for phrase, d, w in zip(np.repeat(found, count).tolist(), owner[at].tolist(), word[at].tolist()):
                yield d, w, size, items[phrase]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by half-open spans; touching spans become one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def shard_results(texts: list[str | None], block: Block, spans: list[list], items: list[set]) -> list[int]:
    """Adds the block's hits in ``texts`` to ``spans`` and ``items``; the texts' numbers of words."""
    get, sizes = block.vocabulary.get, [0] * len(texts)
    shard, begun = Shard(block), 0
    words: list[bytes] = []
    doc: list[int] = []
    count: list[int] = []
    first: list[int] = []

    def flush() -> None:
        if words:
            n = np.array(count)
            ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            starts = np.cumsum(n) - n
            shard.add(ids, np.repeat(np.array(doc), n), np.repeat(np.array(first) - starts, n) + np.arange(len(words)))
            words.clear(), doc.clear(), count.clear(), first.clear()

    def search() -> None:
        nonlocal shard
        flush()
        for d, w, size, owners in shard.hits():
            spans[d].append((w, w + size))
            items[d].update(owners)
        shard = Shard(block)

    for k, text in enumerate(texts):
        parts = list(word_parts(text))
        if len(parts) > 1:  # a long text: its parts are looked up together, cut where no word is
            flush()
            ids = np.concatenate([np.fromiter(map(get, p, repeat(0)), np.int64, len(p)) for p in parts])
            sizes[k] = len(ids)
            shard.add(ids, np.full(len(ids), k), np.arange(len(ids)))
        elif parts:
            words += parts[0]
            words.append(b"")  # in no vocabulary: keeps documents apart
            doc.append(k), count.append(len(parts[0]) + 1), first.append(0)
            sizes[k] = len(parts[0])
            if len(words) > 1 << 18:
                flush()
        if shard.size > SHARD_SYMBOLS or k - begun >= SHARD_DOCS:
            search()
            begun = k + 1
    search()
    return sizes


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, ngram: int, block_words: int) -> Iterator[Block]:
    """Blocks of whole items of about ``block_words`` words, streamed."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        words = [w for part in word_parts(text) for w in part]
        held.append((item, words))
        size += len(words)
        if size >= block_words:
            yield Block(held, ngram)
            held, size = [], 0
    if size:
        yield Block(held, ngram)


def find_hits(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (merged hit words, half-open) and ``items`` (sorted ids as text).

    A phrase is ``ngram`` consecutive words of an item, or all words of a shorter
    one.  Null texts have no words; null item ids count as the empty text; items
    that repeat an id count as one.  All columns of ``docs`` are kept, those named
    like the added ones are replaced; with ``keep`` only these come back, so that texts
    are not sent out of Python again.  Without items, or documents, nothing is hit.
    """
    ship_by_value("tilespark.llm.decontaminate", "tilespark.llm.fm_index")
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    df = docs.drop("n_words", "spans", "items")
    plain = df.columns
    df = df.select("*", F.lit(0).cast("long").alias("n_words"),
                   F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    where, added = plain.index(text_col), ["n_words", "spans", "items"]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def with_block(df: DataFrame, block: Block, out: list[str]) -> DataFrame:
        schema = df.select(*out, *added).schema
        shared = spark.sparkContext.broadcast((block.vocabulary, block.phrases, block.least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Block([], ngram)
            own.vocabulary, own.phrases, own.least = shared.value
            for b in batches:
                n = len(plain)
                spans = [[(x["start"], x["end"]) for x in row] for row in b.column(n + 1).to_pylist()]
                items = [set(row) for row in b.column(n + 2).to_pylist()]
                sizes = shard_results(b.column(where).to_pylist(), own, spans, items)
                found = [pa.array(sizes, pa.int64()),
                         pa.array([[{"start": s, "end": e} for s, e in merged(x)] for x in spans], span_type),
                         pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), *found], [*out, *added])

        return df.mapInArrow(run, schema)

    last = Block([], ngram)
    for k, block in enumerate(blocks_of(benchmark, item_col, item_text_col, ngram, block_words)):
        if k:
            df = stored(with_block(df, last, plain), "hits")
        last = block
    return with_block(df, last, plain if keep is None else keep)


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words start..end-1 of each span (from the first word's start to the last word's end)."""
    data = text.encode()
    kept, at, span, k = [], 0, iter(spans), 0
    now = next(span, None)
    for m in WORD_BYTES.finditer(data):
        if now is None:
            break
        if k == now[0]:
            kept.append(data[at:m.start()])
        if k == now[1] - 1:
            at = m.end()
            now = next(span, None)
        k += 1
    return b"".join([*kept, data[at:]]).decode()


def without_hits(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """Result of ``find_hits`` with the spans cut out of the text; rows whose words were all hit are dropped."""
    ship_by_value("tilespark.llm.decontaminate", "tilespark.llm.fm_index")
    where = hits.columns.index(text_col)
    at = hits.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(where)
            hit = [k for k, n in enumerate(pc.list_value_length(b.column(at)).to_pylist()) if n]
            if hit:
                new = texts.to_pylist()
                for k in hit:
                    new[k] = cut_out(new[k], [(x["start"], x["end"]) for x in b.column(at)[k].as_py()])
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([texts if k == where else c for k, c in enumerate(b.columns)], b.schema.names)

    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    bound_arrow_batches(hits.sparkSession)
    return hits.where((F.size("spans") == 0) | (lost < F.col("n_words"))).mapInArrow(run, hits.schema)
