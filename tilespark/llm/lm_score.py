"""LM scoring with an Elias-Fano n-gram trie (unigrams and bigrams).

Documents are packed into slices.  A slice sends its distinct words and word
pairs with their counts in training documents; the pairs go to the shard of
their first word, so a shard has all followers of a context together.  Contexts
that a sample shows to be above their share of a shard are spread over all
shards by the whole pair (that choice moves work, not results).

A shard adds the counts up and writes its part of the trie into the shared
folder: level 1 holds the contexts, their counts and the monotone pointers into
level 2 as Elias-Fano sequences; level 2 holds, for each context, the ranks of
its followers in the shard's vocabulary, offset by the context so that the whole
level ascends, and a quantised value each.  The file is memory-mapped (read,
where the store cannot map) and asked for every pair sent, by a successor search
between the context's pointers.

Smoothing is interpolated absolute discounting:
p(w|v) = (count(v w) - D) / count(v) + D * followers(v) / count(v) * base(w).
The discounted count is what level 2 quantises: counts up to 127 exactly, larger
ones in steps of 15 %.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import fresh_dir, lower_az, partitions, stored
from tilespark.llm.elias_fano import EliasFano, from_file, to_file
from tilespark.llm.slices import LAST, from_low_bytes, loaded, low_bytes, pack_slices, packed, unpacked
from tilespark.llm.source_mix import KEY_BITS, random_key
from tilespark.llm.warc_zip import open_store
from tilespark.session import bound_arrow_batches, ship_by_value

SLICE_BYTES = 8 << 20
DISCOUNT, PSEUDO = 0.75, 0.1
SEED = 42
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = re.compile(rb"[\x20\x09-\x0d]")
END = b"\n"  # no word has it
PART_BYTES = 1 << 20
#: Bytes of a word's hash that name it inside a bucket, and inside a context's followers.
CODE_BYTES, AFTER_BYTES = 7, 5
HEAVY = 1 << 8 * CODE_BYTES  # added to a heavy context's number
AFTERS = 1 << 8 * AFTER_BYTES
EXACT, GROWTH = 127, 1.15


def quantised(count: np.ndarray) -> np.ndarray:
    """A byte for each count; 0 for none."""
    large = EXACT + np.round(np.log(np.maximum(count, EXACT) / EXACT) / np.log(GROWTH))
    return np.minimum(255, np.where(count <= EXACT, count, large)).astype(np.uint8)


def discounted(code: np.ndarray) -> np.ndarray:
    """The discounted count that a byte stands for."""
    code = code.astype(np.float64)
    return np.where(code > 0, np.where(code <= EXACT, code, EXACT * GROWTH ** (code - EXACT)) - DISCOUNT, 0.0)


class Tally(NamedTuple):
    """A slice's tokens, words and pairs."""
    token: np.ndarray  # word of each token
    first: np.ndarray  # first token of each document
    size: np.ndarray  # tokens of each document
    end: int  # the word for the end
    count: np.ndarray  # of each word in training documents
    pair: np.ndarray  # pair of each token: the word before it (or the begin) and itself
    before: np.ndarray  # of each pair; the begin is one more than the last word
    after: np.ndarray
    pair_count: np.ndarray
    code: np.ndarray  # of each word: low bits of its hash
    bucket: np.ndarray  # of each word
    pair_bucket: np.ndarray
    context: np.ndarray  # of each pair: code of its first word, or HEAVY + number
    words: np.ndarray  # in the order of bucket and code
    pairs: np.ndarray  # in the order of bucket and context


def tally(ends: np.ndarray, data: np.ndarray, marks: np.ndarray, heavy: np.ndarray, n_buckets: int) -> Tally:
    from xxhash import xxh64_intdigest

    raw = data.tobytes().translate(LOWER_AZ)
    vocabulary: defaultdict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__  # a new word gets the next number
    vocabulary[END]
    tokens: list[np.ndarray] = []
    held: list[bytes] = []
    size = np.ones(len(ends), np.int64)

    def flush() -> None:
        tokens.append(np.fromiter(map(vocabulary.__getitem__, held), np.int64, len(held)))
        held.clear()

    start = 0
    for k, end in enumerate(ends.tolist()):
        while start < end:
            to = end
            if end - start > PART_BYTES:
                gap = SPACE.search(raw, start + PART_BYTES, end)
                to = gap.start() if gap else end
            words = raw[start:to].split()
            size[k] += len(words)
            held += words
            start = to
            if len(held) > 1 << 18:
                flush()
        held.append(END)
    flush()
    token = np.concatenate(tokens)
    n = len(vocabulary)
    hashes = np.fromiter(map(xxh64_intdigest, vocabulary, repeat(SEED)), np.uint64, n)
    first = np.cumsum(size) - size
    train = np.repeat(marks, size)
    before = np.r_[n, token[:-1]]
    before[first] = n
    key = before * (n + 1) + token
    order = np.argsort(key)
    fresh = np.r_[True, np.diff(key[order]) != 0]
    head = np.flatnonzero(fresh)
    pair = np.empty(len(key), np.int64)
    pair[order] = np.cumsum(fresh) - 1
    pair_count = np.add.reduceat(train[order].astype(np.int64), head)
    before, after = np.divmod(key[order][head], n + 1)
    # heavy[0] is the begin
    number = np.minimum(np.searchsorted(heavy[1:], hashes) + 1, len(heavy) - 1)
    number = np.r_[np.where((number > 0) & (heavy[number] == hashes), number, -1), 0]
    n_buckets = np.uint64(n_buckets)
    bucket = ((hashes >> np.uint64(32)) * n_buckets >> np.uint64(32)).astype(np.int64)
    both = np.r_[hashes, np.uint64(1)][before] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[after]
    both *= np.uint64(0xC2B2AE3D27D4EB4F)
    spread = ((both >> np.uint64(32)) * n_buckets >> np.uint64(32)).astype(np.int64)
    code = (hashes & np.uint64(HEAVY - 1)).astype(np.int64)
    is_heavy = number[before] >= 0
    pair_bucket = np.where(is_heavy, spread, np.r_[bucket, 0][before])
    words = np.lexsort((code, bucket))
    rank = np.empty(n + 1, np.int64)
    rank[words] = np.arange(n)
    pairs = np.argsort(pair_bucket << 32 | np.where(is_heavy, (1 << 31) + number[before], rank[before]), kind="stable")
    return Tally(token, first, size, 0, np.bincount(token, train, n).astype(np.int64), pair, before, after, pair_count, code, bucket,
                 pair_bucket, np.where(is_heavy, HEAVY + number[before], np.r_[code, 0][before]), words, pairs)


def in_buckets(t: Tally) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, its words in the order of their codes, its pairs in the order of their contexts)."""
    words, pairs = t.words, t.pairs
    word_bucket, pair_bucket = t.bucket[words], t.pair_bucket[pairs]
    for b in np.union1d(word_bucket, pair_bucket).tolist():
        yield (b, words[np.searchsorted(word_bucket, b):np.searchsorted(word_bucket, b, "right")],
               pairs[np.searchsorted(pair_bucket, b):np.searchsorted(pair_bucket, b, "right")])


SENT = ("bucket int, slice long, codes binary, counts binary, contexts binary, followers binary, after binary, pair_counts binary")


def sent_rows(t: Tally) -> Iterator[tuple]:
    for b, words, pairs in in_buckets(t):
        context = t.context[pairs]
        head = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        fan = np.diff(np.r_[head, len(pairs)])
        # a context that is a word of this bucket is named by its place, the others by their numbers
        own = context[head] < HEAVY
        place = np.searchsorted(t.code[words], context[head][own])
        followers = np.zeros(len(words), np.int64)
        followers[place] = fan[own]
        yield (b, low_bytes(t.code[words], CODE_BYTES), packed(t.count[words]),
               packed(context[head][~own] - HEAVY), packed(np.r_[followers, fan[~own]]),
               low_bytes(t.code[t.after[pairs]], AFTER_BYTES), packed(t.pair_count[pairs]))


class Shard:
    """A shard of the trie over the arrays of its file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        part = lambda name: EliasFano({k: arrays[f"{name}.{k}"] for k in EliasFano.NAMES})
        self.contexts, self.totals, self.pointers = part("contexts"), part("totals"), part("pointers")
        self.vocabulary, self.followers, self.values = part("vocabulary"), part("followers"), arrays["values"]

    @staticmethod
    def build(context: np.ndarray, total: np.ndarray, of: np.ndarray, after: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        """``context`` ascends and has ``total`` tokens each; pairs (index of context, code) ascend and have ``count``."""
        words, rank = np.unique(after, return_inverse=True)
        fan = np.bincount(of, minlength=len(context))
        parts = {"contexts": (context, 2 * HEAVY), "totals": (np.cumsum(total), int(total.sum()) + 1),
                 "pointers": (np.r_[0, np.cumsum(fan)], len(of) + 1), "vocabulary": (words, AFTERS),
                 "followers": (of * len(words) + rank, max(1, len(context) * len(words)))}
        arrays = {f"{name}.{k}": a for name, (values, universe) in parts.items()
                  for k, a in EliasFano.build(values, universe).arrays.items()}
        return arrays | {"values": quantised(count)}

    def context_of(self, context: np.ndarray) -> np.ndarray:
        return self.contexts.find(context)

    def total(self, i: np.ndarray) -> np.ndarray:
        """Tokens of context i (0 for -1)."""
        j = np.maximum(i, 0)
        if not self.totals.n:
            return np.zeros(len(i), np.int64)
        before = np.where(j > 0, self.totals.get(np.maximum(j - 1, 0)), 0)
        return np.where(i >= 0, self.totals.get(j) - before, 0)

    def fan(self, i: np.ndarray) -> np.ndarray:
        """Followers of context i (0 for -1)."""
        j = np.maximum(i, 0)
        return np.where(i >= 0, self.pointers.get(j + (i >= 0)) - self.pointers.get(j), 0)

    def value(self, i: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Quantised value of the pairs (context i, follower's code); 0 where the trie has none."""
        out = np.zeros(len(i), np.uint8)
        if not len(self.values):
            return out
        rank = self.vocabulary.find(after)
        ok = np.flatnonzero((i >= 0) & (rank >= 0))
        i = i[ok]
        low, high = self.pointers.get(i), self.pointers.get(i + 1)
        x = i * self.vocabulary.n + rank[ok]
        at = self.followers.successor(x, low, high)
        hit = at < high
        hit[hit] = self.followers.get(at[hit]) == x[hit]
        out[ok[hit]] = self.values[at[hit]]
        return out


def mapped(path: str):
    """The file's bytes: mapped where the store is a mounted one, read otherwise."""
    from pyarrow import fs

    store, where = open_store(path)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(where).read_buffer()
    with store.open_input_file(where) as f:
        return f.read_buffer()


ANSWER = ("slice long, bucket int, totals binary, fans binary, values binary, tokens long, words long, "
          "heavy array<long>, heavy_fans array<long>")


def shard_answers(rows: list[tuple], folder: str) -> Iterator[tuple]:
    """Builds one bucket's shard from what the slices sent, and answers each of them."""
    codes = [from_low_bytes(r[2], CODE_BYTES).astype(np.int64) for r in rows]
    counts = [unpacked(r[3]) for r in rows]
    after = [from_low_bytes(r[6], AFTER_BYTES).astype(np.int64) for r in rows]
    context = [np.repeat(np.r_[c, unpacked(r[4]) + HEAVY], unpacked(r[5])) for c, r in zip(codes, rows)]
    word_size, pair_size = [len(x) for x in codes], [len(x) for x in after]
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    context, after, pair_counts = np.concatenate(context), np.concatenate(after), np.concatenate([unpacked(r[7]) for r in rows])
    words, word = np.unique(codes, return_inverse=True)
    word_total = np.bincount(word, counts, len(words)).astype(np.int64)
    order = np.lexsort((after, context))
    c, a = context[order], after[order]
    fresh = np.r_[True, (c[1:] != c[:-1]) | (a[1:] != a[:-1])] if len(c) else np.zeros(0, bool)
    head = np.flatnonzero(fresh)
    pair = np.empty(len(c), np.int64)
    pair[order] = np.cumsum(fresh) - 1
    pair_total = np.add.reduceat(pair_counts[order], head) if len(head) else np.zeros(0, np.int64)
    c, a = c[head], a[head]
    known = np.flatnonzero(pair_total)
    heavy = np.unique(c[known][c[known] >= HEAVY])
    contexts = np.r_[words[word_total > 0], heavy]
    arrays = Shard.build(contexts, np.r_[word_total[word_total > 0], np.zeros(len(heavy), np.int64)],
                         np.searchsorted(contexts, c[known]), a[known], pair_total[known])
    store, where = open_store(folder)
    store.create_dir(where, recursive=True)
    name = f"shard-{uuid.uuid4().hex}.trie"
    with store.open_output_stream(f"{where.rstrip('/')}/{name}") as f:
        f.write(to_file(arrays))
    del arrays
    shard = Shard(from_file(mapped(f"{folder.rstrip('/')}/{name}")))
    at = shard.context_of(words)
    total, fan = shard.total(at)[word], shard.fan(at)[word]
    value = np.concatenate([shard.value(shard.context_of(c[i:i + (1 << 18)]), a[i:i + (1 << 18)])
                            for i in range(0, len(c), 1 << 18)] or [np.zeros(0, np.uint8)])[pair]
    w = p = 0
    for r, n, m in zip(rows, word_size, pair_size):
        yield (r[1], r[0], packed(total[w:w + n]), packed(fan[w:w + n]), value[p:p + m].tobytes(), None, None, None, None)
        w, p = w + n, p + m
    yield (None, rows[0][0], None, None, None, int(word_total.sum()), int((word_total > 0).sum()), (heavy - HEAVY).tolist(),
           shard.fan(shard.context_of(heavy)).tolist())


def heavy_contexts(docs: DataFrame, n: int, text_col: str, id_col: str, sample_docs: int) -> np.ndarray:
    """Hashes of the words with more than 1 / (4 n) of a sample's tokens (fewer than 4 n words),
    ascending behind the begin, which is always heavy."""
    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))
    words = (docs.where(random_key(F.col(id_col)) <= int(share * (1 << KEY_BITS)))
             .select(F.explode(F.split(lower_az(F.col(text_col)), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
             .groupBy(F.xxhash64("w").alias("h")).agg(F.count(F.lit(1)).alias("c")))
    words = stored(words, "lm-sample")
    tokens = words.agg(F.sum("c")).first()[0] or 0
    found = [r["h"] % (1 << 64) for r in words.where(F.col("c") > tokens / (4 * n)).select("h").collect()]
    return np.array([1, *sorted(found)], np.uint64)


def lm_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
              sample_docs: int = 2000) -> DataFrame:
    """One row per row: id, ``training``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are words after A-Z are lower-cased, then one end.  The model learns
    from all rows where ``training`` holds (null counts as false) and scores all
    rows.  ``base_score`` adds up log10((c + 0.1) / (N + 0.1 (V + 1))), ``score``
    the bigram model's log10 probabilities.  A null text is empty: its end is its
    only token.  Without training rows N and V are 0.  Ids are integers or null;
    rows that repeat an id are scored each.  Other columns are ignored.
    """
    ship_by_value("tilespark.llm.lm_score", "tilespark.llm.elias_fano", "tilespark.llm.slices", "tilespark.llm.warc_zip")
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    n = partitions(spark)
    heavy = heavy_contexts(docs, n, text_col, id_col, sample_docs)
    slices = pack_slices(docs, id_col, text_col, n, training, SLICE_BYTES)
    folder = fresh_dir(spark, "lm-trie")

    def tallied(b: pa.RecordBatch, row: int) -> tuple[np.ndarray, Tally]:
        ids, ends, data = loaded(b["ids"][row].as_py(), b["ends"][row].as_py(), b["data"][row].as_buffer())
        return ids, tally(ends, data, np.array(b["marks"][row].as_py(), bool), heavy, n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = SENT.replace(",", "").split()[::2]
        for b in batches:
            for row in range(b.num_rows):
                out = list(zip(*sent_rows(tallied(b, row)[1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array([b["slice"][row].as_py()] * len(out[0]), pa.int64()),
                     *(pa.array(x, pa.binary()) for x in out[1:])], names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = re.findall(r"(\w+) (?:long|int|binary|array)", ANSWER)
        while rows:
            cut = next((k for k, r in enumerate(rows) if r[0] != rows[0][0]), len(rows))
            part, rows = rows[:cut], rows[cut:]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*shard_answers(part, folder)), types)], names)

    got = stored(slices.mapInArrow(send, SENT).repartitionById(n, "bucket").mapInArrow(answer, ANSWER), "lm-answers")
    sums = got.where("slice IS NULL")
    total = sums.agg(F.sum("tokens"), F.sum("words")).first()
    n_tokens, n_words = total[0] or 0, total[1] or 0
    fans = np.zeros(len(heavy), np.int64)  # fewer than 4 n + 1
    for k, x in (sums.select(F.explode(F.arrays_zip("heavy", "heavy_fans")).alias("x")).groupBy("x.heavy")
                 .agg(F.sum("x.heavy_fans")).collect()):
        fans[k] = x
    by_slice = (got.where("slice IS NOT NULL").groupBy("slice")
                .agg(F.collect_list(F.struct("bucket", "totals", "fans", "values")).alias("found")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, t = tallied(b, row)
                count, fan = np.zeros(len(t.code), np.int64), np.zeros(len(t.code) + 1, np.int64)
                value = np.zeros(len(t.before), np.uint8)
                found = {x["bucket"]: x for x in b["found"][row].as_py()}
                for bucket, words, pairs in in_buckets(t):
                    x = found[bucket]
                    count[words], fan[words] = unpacked(x["totals"]), unpacked(x["fans"])
                    value[pairs] = np.frombuffer(x["values"], np.uint8)
                is_heavy = t.context >= HEAVY
                fan[t.before[is_heavy]] = fans[t.context[is_heavy] - HEAVY]
                base = (count + PSEUDO) / (n_tokens + PSEUDO * (n_words + 1))
                context = np.r_[count, count[t.end]][t.before]  # a document begins as often as it ends
                seen = np.maximum(context, 1)
                p = np.where(context > 0, discounted(value) / seen + DISCOUNT * fan[t.before] / seen * base[t.after], base[t.after])
                sums = lambda x: np.add.reduceat(x, t.first)
                known = sums((count > 0)[t.token].astype(np.int64))
                base_score, score = sums(np.log10(base)[t.token]), sums(np.log10(np.minimum(p, 1.0))[t.pair])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if x == LAST else x for x in ids.tolist()], pa.int64()), pa.array(b["marks"][row].as_py(), pa.bool_()),
                     pa.array(t.size), pa.array(known), pa.array(np.full(len(ids), n_tokens, np.int64)), pa.array(base_score), pa.array(score)],
                    ["id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    final = slices.join(by_slice, "slice").select("ids", "marks", "ends", "data", "found")
    return final.mapInArrow(score, "id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                                   "score double").withColumnRenamed("id", id_col)
