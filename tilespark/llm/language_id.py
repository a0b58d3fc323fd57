"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words.  The piece
probabilities are learned by EM (expected counts by forward-backward) from a
bounded sample of labelled documents, about ``docs_per_language`` of each
language and ``train_rows`` in all; every word of these is learned from.  A round
of EM is a job over the counts of (language, word): tasks send expected counts per
(language, piece), which are what the model holds, so it alone reaches the driver
and is broadcast.  Scoring is a map over all documents without a shuffle; it
takes languages in blocks and letter runs of any length whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.llm.common import few, stored
from tilespark.llm.source_mix import KEY_BITS, random_key
from tilespark.session import bound_arrow_batches, ship_by_value

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
SPACE = "▁"  # the vocabulary's mark of a word's start
WORD = re.compile(r"[^\W\d_]+")
#: Words of at most so many letters are summed many at once (their sums stay in range); longer
#: ones alone, in blocks of places, rescaled on the way.
SHORT_WORD, PLACES_AT_ONCE, RESCALE = 24, 4096, 16
LANGUAGES_AT_ONCE = 64
CHARS_AT_ONCE = 1 << 20
CACHED_WORDS, CACHED_SCORES = 200_000, 1_600_000
#: Probability of a character outside the vocabulary, the same for all languages.
OUTSIDE = 1e-8
#: What expected counts are rounded to between tasks.
UNIT = 2.0 ** -24


class Pieces(NamedTuple):
    """The vocabulary as a prefix tree: node 0 is the root; a step's key is node * letters + letter."""
    letters: np.ndarray  # sorted code points
    keys: np.ndarray  # sorted
    child: np.ndarray  # node reached by each key
    piece: np.ndarray  # of each node, -1 where none ends
    size: int
    longest: int


class Model(NamedTuple):
    languages: list[str]
    pieces: Pieces
    prob: np.ndarray  # pieces x languages; the last row is for characters outside


def read_pieces(path: str) -> Pieces:
    """Lower-case letter pieces of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return piece_tree([p for p in map(sp.id_to_piece, range(sp.get_piece_size()))
                       if (q := p.removeprefix(SPACE)).isalpha() and q == q.lower() or p == SPACE])


def piece_tree(names: list[str]) -> Pieces:
    names = list(dict.fromkeys(names))
    letters = sorted({ord(c) for p in names for c in p})
    place = {c: i for i, c in enumerate(letters)}
    nodes, steps, piece = {"": 0}, {}, [-1]
    for k, p in enumerate(names):
        for n in range(1, len(p) + 1):
            if p[:n] not in nodes:
                nodes[p[:n]] = len(nodes)
                piece.append(-1)
                steps[nodes[p[:n - 1]] * len(letters) + place[ord(p[n - 1])]] = nodes[p[:n]]
        piece[nodes[p]] = k
    keys = np.array(sorted(steps), np.int64)
    return Pieces(np.array(letters, np.int64), keys, np.array([steps[k] for k in keys.tolist()], np.int64), np.array(piece, np.int64), len(names),
                  max(map(len, names)))


def lattice(words: list[str], pieces: Pieces) -> tuple[np.ndarray, ...]:
    """All pieces in all words (their marks in front) as arrays (word, start, end, piece), and the words' lengths.
    A character that is no piece itself gets the piece for characters outside."""
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[word] - begin
    letter = np.minimum(np.searchsorted(pieces.letters, text), len(pieces.letters) - 1)
    letter[pieces.letters[letter] != text] = -1
    at, node, found = np.arange(len(text)), np.zeros(len(text), np.int64), []
    for n in range(pieces.longest):
        go = left[at] > n
        at, node = at[go], node[go]
        c = letter[at + n]
        key = node * len(pieces.letters) + c
        k = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
        ok = (pieces.keys[k] == key) & (c >= 0)
        piece = np.where(ok, pieces.piece[pieces.child[k]], -1)
        if n == 0:
            found.append((at, np.where(piece < 0, pieces.size, piece), 1))
        else:
            real = piece >= 0
            found.append((at[real], piece[real], n + 1))
        at, node = at[ok], pieces.child[k][ok]
        if not len(at):
            break
    at = np.concatenate([x for x, _, _ in found])
    start = begin[at]
    end = start + np.concatenate([np.full(len(x), n) for x, _, n in found])
    return word[at], start, end, np.concatenate([x for _, x, _ in found]), sizes


def by_place(place: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by place, then word; both are small numbers, so two stable passes over few bits."""
    order = np.argsort(word.astype(np.uint16), kind="stable")
    return order[np.argsort(place[order].astype(np.uint8), kind="stable")]


def _swept(prob_of_edge: np.ndarray, group: np.ndarray, into: np.ndarray, out_of: np.ndarray, at: np.ndarray,
           order: range, table: np.ndarray) -> None:
    """table[word, x] = sum over edges with into == x of table[word, out_of] * prob, x in ``order``.
    ``group`` sorts the edges by ``into``, then word."""
    sorted_into = into[group]
    for x in order:
        e = group[np.searchsorted(sorted_into, x):np.searchsorted(sorted_into, x, "right")]
        if len(e):
            first = np.flatnonzero(np.r_[True, at[e][1:] != at[e][:-1]])
            table[at[e][first], x] += np.add.reduceat(table[at[e], out_of[e]] * prob_of_edge[e], first, axis=0)


def words_at_once(languages: int) -> int:
    """Words whose lattices are summed together: bounded memory for any number of languages."""
    return max(64, min(4096, 16_384 // max(1, languages)))


def forward(words: list[str], model: Model) -> np.ndarray:
    """log probability of each word (rows) in each language: all segmentations summed."""
    out = np.zeros((len(words), len(model.languages)))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    blocks = [slice(i, i + LANGUAGES_AT_ONCE) for i in range(0, len(model.languages), LANGUAGES_AT_ONCE)]
    short, step = np.flatnonzero(sizes <= SHORT_WORD), words_at_once(min(len(model.languages), LANGUAGES_AT_ONCE))
    for i in range(0, len(short), step):
        rows = short[i:i + step]
        at, start, end, piece, length = lattice([SPACE + words[k] for k in rows], model.pieces)
        group = by_place(end, at)
        for b in blocks:
            p = model.prob[piece, b]
            alpha = np.zeros((len(rows), int(length.max()) + 1, p.shape[1]))
            alpha[:, 0] = 1
            _swept(p, group, end, start, at, range(1, alpha.shape[1]), alpha)
            out[rows, b] = np.log(alpha[np.arange(len(rows)), length])
    for k in np.flatnonzero(sizes > SHORT_WORD):
        for b in blocks:
            out[k, b] = _long(words[k], model.pieces, model.prob[:, b])
    return out


def _places(text: str, pieces: Pieces) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The lattice of a long word in blocks of places: the block's places, and by start the pieces' bounds, lengths and numbers."""
    for b in range(0, len(text), PLACES_AT_ONCE):
        size = min(PLACES_AT_ONCE, len(text) - b)
        _, start, end, piece, _ = lattice([text[b:b + size + pieces.longest - 1]], pieces)
        order = np.argsort(start, kind="stable")
        yield size, np.searchsorted(start[order], np.arange(size + 1)), (end - start)[order], piece[order]


def _long(word: str, pieces: Pieces, prob: np.ndarray, kept: list | None = None) -> np.ndarray:
    """The forward sums of one word of any length; only the places that a piece can span are held, rescaled
    as they move.  ``kept`` gets (bounds, lengths, pieces, sums, scales so far) of each block."""
    ahead, shift = np.zeros((1, prob.shape[1])), np.zeros(prob.shape[1])
    ahead[0] = 1
    for size, bound, length, piece in _places(SPACE + word, pieces):
        table = np.zeros((size + pieces.longest + 1, prob.shape[1]))
        table[:len(ahead)] = ahead
        shifts = np.zeros((size, prob.shape[1]))
        for s in range(size):
            if s % RESCALE == 0:
                near = table[s:s + pieces.longest + 1]
                top = near.max(axis=0)
                near /= top
                shift = shift + np.log(top)
            shifts[s] = shift
            e = slice(bound[s], bound[s + 1])
            table[s + length[e]] += table[s] * prob[piece[e]]
        ahead = table[size:]
        if kept is not None:
            kept.append((bound, length, piece, table[:size].copy(), shifts))
    return np.log(ahead[0]) + shift


def _long_counts(word: str, lang: int, n: int, model: Model, total: np.ndarray) -> None:
    """Adds the expected pieces of a long word that a language has ``n`` times, by forward-backward."""
    prob, blocks = model.prob[:, lang], []
    z = _long(word, model.pieces, prob[:, None], blocks)[0]
    longest = model.pieces.longest
    behind, shift = np.zeros(longest + 1), 0.0  # sums from a place to the word's end, those of the next places
    behind[0] = 1
    for bound, length, piece, alpha, shifts in reversed(blocks):
        size = len(alpha)
        table = np.zeros(size + longest + 1)
        table[size:] = behind
        for s in range(size - 1, -1, -1):
            e = slice(bound[s], bound[s + 1])
            ways = prob[piece[e]] * table[s + length[e]]
            table[s] = ways.sum()
            np.add.at(total[:, lang], piece[e], n * alpha[s, 0] * ways * np.exp(shifts[s, 0] + shift - z))
            if s % RESCALE == 0:
                near = table[s:s + longest + 1]
                top = near.max()
                near /= top
                shift += np.log(top)
        behind = table[:longest + 1].copy()


def expected(words: list[str], lang: np.ndarray, n: np.ndarray, model: Model, total: np.ndarray) -> None:
    """Adds to ``total`` (pieces x languages) the expected pieces of ``words``, each ``n`` times in its language."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(sizes <= SHORT_WORD)
    for i in range(0, len(short), 4096):
        rows = short[i:i + 4096]
        at, start, end, piece, length = lattice([SPACE + words[k] for k in rows], model.pieces)
        p = model.prob[piece, lang[rows][at]][:, None]
        most, each = int(length.max()), np.arange(len(rows))
        alpha = np.zeros((len(rows), most + 1, 1))
        alpha[:, 0] = 1
        _swept(p, by_place(end, at), end, start, at, range(1, most + 1), alpha)
        beta = np.zeros_like(alpha)
        beta[each, length] = 1
        _swept(p, by_place(start, at), start, end, at, range(most - 1, -1, -1), beta)
        share = (alpha[at, start] * p * beta[at, end])[:, 0] * (n[rows] / alpha[each, length, 0])[at]
        np.add.at(total.reshape(-1), piece * total.shape[1] + lang[rows][at], share)
    for k in np.flatnonzero(sizes > SHORT_WORD):
        _long_counts(words[k], int(lang[k]), int(n[k]), model, total)


def improved(counted: DataFrame, model: Model, prior: float) -> Model:
    """One round of EM over ``counted`` (lang, word, n).  Expected counts are summed as whole multiples
    of ``UNIT``, so that the order of the sums does not matter."""
    shared = counted.sparkSession.sparkContext.broadcast((model.languages, tuple(model.pieces), model.prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, tree, prob = shared.value
        model, number = Model(languages, Pieces(*tree), prob), {x: k for k, x in enumerate(languages)}
        total = np.zeros_like(prob)
        for b in batches:
            lang = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            expected(b.column(1).to_pylist(), lang, b.column(2).to_numpy(), model, total)
        units = np.rint(total[:-1].ravel() / UNIT).astype(np.int64)
        cell = np.flatnonzero(units)
        for i in range(0, len(cell), 10_000):
            part = cell[i:i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(units[part])], ["cell", "units"])

    sums = counted.select("lang", "word", "n").mapInArrow(run, "cell long, units long").groupBy("cell").agg(F.sum("units").alias("units")).toArrow()
    total = np.zeros((model.pieces.size, len(model.languages)))
    total.ravel()[sums["cell"].to_numpy()] = sums["units"].to_numpy() * UNIT
    total += prior
    return model._replace(prob=np.vstack([total / total.sum(axis=0), model.prob[-1:]]))


def train(docs: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          vocabulary: str = VOCABULARY, docs_per_language: int = 1000, train_rows: int = 1_000_000,
          rounds: int = 4, prior: float = 0.01) -> Model:
    """Learn from rows where ``allowed`` holds and text and language are not null.

    About ``docs_per_language`` rows of each language are read, fewer if there are so many languages that they
    would be more than ``train_rows``; no language, word or piece in these is left out."""
    ship_by_value("tilespark.llm.language_id")
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = few(rows.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n")), "languages")
    share = min(float(docs_per_language), train_rows / max(1, sizes.count()))
    # keys are uniform in [0, 2^60): a threshold for each language keeps about as many documents as asked for
    most = (F.least(F.lit(1.0), F.lit(share) / F.col("__n")) * float(1 << KEY_BITS)).cast("long")
    sample = (rows.select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"), random_key(F.col(id_col)).alias("__key"))
              .join(sizes, "__lang").where(F.col("__key") < most).select("__lang", "__text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.update((lang, w) for w in WORD.findall(text.lower()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                              pa.array(seen.values(), pa.int64())], ["lang", "word", "n"])

    counted = (sample.mapInArrow(tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    # in order and stored, so that every round sums alike
    counted = stored(counted.sortWithinPartitions("word", "lang"), "lang-words")
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not languages:
        return Model([], piece_tree([SPACE]), np.zeros((2, 0)))
    pieces = read_pieces(vocabulary)
    model = Model(languages, pieces, np.full((pieces.size + 1, len(languages)), 1 / pieces.size))
    model.prob[-1] = OUTSIDE
    for _ in range(rounds):
        model = improved(counted, model, prior)
    return model


def text_parts(text: str) -> Iterator[str]:
    """The text in parts of about ``CHARS_AT_ONCE``, cut only where no letter run is."""
    at = 0
    while at < len(text):
        to = at + CHARS_AT_ONCE
        while to < len(text) and text[to].isalnum() and text[to - 1].isalnum():
            to += 1
        yield text[at:to]
        at = to


def scorer(model: Model):
    """A function from texts to (language, score) with a bounded cache of word scores."""
    n_lang = len(model.languages)
    cache: dict[str, int] = {}
    most = max(1024, min(CACHED_WORDS, CACHED_SCORES // max(1, n_lang)))
    rows = np.zeros((most, max(1, n_lang)))

    def log_probs(words: list[str]) -> np.ndarray:
        long = np.array([len(w) > SHORT_WORD for w in words])
        if long.any():  # not cached, so that the cache stays small
            got = np.empty((len(words), n_lang))
            got[long] = forward([w for w in words if len(w) > SHORT_WORD], model)
            if not long.all():
                got[~long] = log_probs([w for w in words if len(w) <= SHORT_WORD])
            return got
        new = list({w for w in words if w not in cache})
        if len(cache) + len(new) > most:
            cache.clear()
            new = list(set(words))
        if new and len(new) <= most:
            rows[len(cache):len(cache) + len(new)] = forward(new, model)
            cache.update(zip(new, range(len(cache), len(cache) + len(new))))
        elif new:  # one part with more distinct words than the cache holds
            own = dict(zip(new, range(len(new))))
            return forward(new, model)[np.fromiter(map(own.__getitem__, words), np.int64, len(words))]
        return rows[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]

    def flush(words: list[str], owner: list[int], sizes: list[int], total: np.ndarray) -> None:
        if words:
            got = log_probs(words)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            np.add.at(total, np.array(owner), np.add.reduceat(got, starts, axis=0))
            words.clear(), owner.clear(), sizes.clear()

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not n_lang:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(texts), max(1, n_lang)))
        letters = [False] * len(texts)
        words: list[str] = []
        owner: list[int] = []
        sizes: list[int] = []
        chars = 0
        for k, text in enumerate(texts):
            for part in text_parts(text or ""):
                found = WORD.findall(part.lower())
                if found:
                    letters[k] = letters[k] or any(c.isalpha() for w in found for c in w)
                    words += found
                    owner.append(k), sizes.append(len(found))
                chars += len(part)
                if chars >= CHARS_AT_ONCE:
                    flush(words, owner, sizes, total)
                    chars = 0
        flush(words, owner, sizes, total)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return ([model.languages[b] if x else UNKNOWN for b, x in zip(best, letters)],
                [float(s) if x else 0.0 for s, x in zip(score, letters)])

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred",
             score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the predicted language and its posterior probability (languages equally likely before).

    With ``keep`` only these columns come back with the two, so that texts are not sent out of Python again.

    ``und`` with score 0 for a null text, one without letters, or a model that
    saw no labelled row.  All columns are kept; columns named like the two added
    ones are replaced.  Rows stay where they are, repeated rows get equal results.
    """
    ship_by_value("tilespark.llm.language_id")
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    kept = docs.drop(pred_col, score_col)
    out = [c for c in kept.columns if keep is None or c in keep]
    schema = T.StructType([*(kept.schema[c] for c in out), T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    where = kept.columns.index(text_col)
    shared = spark.sparkContext.broadcast((model.languages, tuple(model.pieces), model.prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, tree, prob = shared.value
        predict = scorer(Model(languages, Pieces(*tree), prob))
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                lang, score = predict(part.column(where).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 [*out, pred_col, score_col])

    return kept.mapInArrow(run, schema)
