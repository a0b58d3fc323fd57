"""Personal data in texts: fixed patterns, and a conditional random field that adds to them.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their
usual forms.  A linear-chain conditional random field over word shapes (``crf``),
trained from a small labelled table, adds other forms of the same kinds; spans
of the patterns always stay.  Labels of a table may come from people (``EXAMPLES``)
and from the patterns themselves (``label_windows``, a bounded sample).

A text's words are its runs without ASCII white space.  A word with a digit, ``@`` or ``+``
is a trigger.  Triggers and the words beside them form chains; every other word
is outside by definition, so a chain is all that the field has to look at, and
most of a text is passed over by one table lookup a byte.  Both parts run in one
map over the documents, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.llm import crf
from tilespark.llm.crf import KINDS
from tilespark.session import bound_arrow_batches, ship_by_value

SPANS = "array<struct<kind:string,start:long,end:long>>"
CHUNK_BYTES = 4 << 20
#: Chains of more words than this are not used for training.
TRAIN_WORDS = 32

# One pass over the text each: a number is only tried from its first digit on, an address only around its "@".
IP = re.compile(rb"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(rb"(?<![0-9])[0-9]+(?:[ -][0-9]+)*")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = np.zeros(256, bool)
LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True

#: Labelled by hand: forms that the patterns pass over, and look-alikes that are no personal data.
EXAMPLES = """
call [phone:212-555-0143] today | phone [phone:(212) 555-0143] please | tel [phone:0171 555 0143] or mail
fax [phone:030/555-0143] and | ring [phone:555-867-5309] now | mobile [phone:0049 171 5550143] only
dial [phone:1-800-555-0199] free | at [phone:(030) 5550 143] daily | number [phone:020 7946 0018] rings
mail [email:jane@localhost] about | write [email:max.müller@beispiel.de] soon | ask [email:info@büro.example] first
send [email:anna@firma] this | from [email:j.doe@intranet] again | to [email:root@server1] and
host [ip:10.0.0.1:8080] is | net [ip:172.16.4.0/24] has | via [ip:10.1.2.3/8] and
card [card:4111.1111.1111.1111] was | paid [card:5500/0000/0000/0004] by | visa [card:4012.8888.8888.1881] ok
on 2024-01-31 we | since 31.12.2023 the | at 12:30:15 he | version 3.11.4 of | section 4.2.1.7.9 says | in 1999-2004 they
chapter 12 and | about 1,250,000 people | cost 19.99 euro | nearly 100% of | in 2007 the | room 4-17 was | score 3-2 for
isbn 978-3-16-148410-0 is | order 20240131-00017 was | id 9823176540 and | build 20231201.4 of | ratio 16:9 and
follow @news today | see @example for | a+b is | c++ code | 5+5 makes | +20 points | grade a+ for | at 1024x768 dots
tracking 1234567890123456 is | number 4845168114407320 was | key 8f14e45fceea167a5a36dedd4bea2543 and | part 00-4711 of
between 10 000 and 20 000 men | rows 1 2 3 4 5 of | law 17/2004 of | page 30/45 and | 12/24/2021 was | phone 911 now
"""
EXAMPLE_WEIGHT = 10.0


# ------------------------------------------------------------ patterns

def _luhn(digits: bytes) -> bool:
    d = [c - 48 for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _octets(dotted: bytes) -> bool:
    return all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in dotted.split(b"."))


def _digits(data: bytes) -> bytes:
    return bytes(c for c in data if 48 <= c <= 57)


def emails(data: bytes) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: the part before an ``@`` is walked back from it."""
    over, at = 0, data.find(b"@")
    while at >= 0:
        start = at
        while start > over and LOCAL[data[start - 1]]:
            start -= 1
        m = DOMAIN.match(data, at + 1) if start < at else None
        if m:
            yield start, m.end()
            over = m.end()
        else:
            over = max(over, at + 1)
        at = data.find(b"@", over)


def patterns(data: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind, then start; matches that fail their check are dropped, not retried."""
    found = [(0, s, e) for s, e in emails(data)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(data) if _octets(m.group())]
    found += [(2, m.start(), m.end()) for m in CARD.finditer(data)
              if 13 <= m.end() - m.start() - m.group().count(b" ") - m.group().count(b"-") <= 19 and _luhn(_digits(m.group()))]
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(data) if 9 <= sum(48 <= c <= 57 for c in m.group()) <= 15]
    return found


# ------------------------------------------------------------ words

#: Character classes: 0 other, 1 digit, 2 letter, 3 capital, 4 "@", 5 ".", 6 "-", 7 "+", 8 "(" or ")"
CLASS = np.zeros(256, np.int64)
CLASS[48:58], CLASS[97:123], CLASS[128:], CLASS[65:91] = 1, 2, 2, 3
CLASS[[64, 46, 45, 43, 40, 41]] = [4, 5, 6, 7, 8, 8]
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
TRIGGER = np.isin(CLASS, [1, 4, 7])
OPENS = np.isin(CLASS, [1, 2, 3]) | np.isin(np.arange(256), [43, 40])
CLOSES = np.isin(CLASS, [1, 2, 3]) | (np.arange(256) == 41)
#: How many values each feature of a word has; see ``chains``.
WIDTHS = [512, 96, 64, 144, 512, 512, 32, 32]


def chains(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chains of words in texts that lie behind each other, white space between them.

    Returns the features (words x len(WIDTHS)), first and last byte of each
    word's core (without marks around it; last < first if it has none), the
    chains' sizes and each chain's text.
    """
    none = np.zeros(0, np.int64)
    space = np.r_[True, SPACE[data], True]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    spots = np.flatnonzero(TRIGGER[data])
    if not len(spots):
        return np.zeros((0, len(WIDTHS)), np.int64), none, none, none, none
    trigger = np.unique(np.searchsorted(starts, spots, "right") - 1)
    doc = lambda w: np.searchsorted(doc_starts, starts[w], "right") - 1
    near, owner = np.concatenate([trigger - 1, trigger, trigger + 1]), np.tile(trigger, 3)
    inside = (near >= 0) & (near < len(starts))
    near, owner = near[inside], owner[inside]
    words = np.unique(near[doc(near) == doc(owner)])
    docs = doc(words)
    fresh = np.r_[True, (np.diff(words) != 1) | (np.diff(docs) != 0)]

    begin, size = starts[words], ends[words] - starts[words]
    word = np.repeat(np.arange(len(words)), size)
    byte = np.arange(len(word)) + np.repeat(begin - (np.cumsum(size) - size), size)
    value = data[byte]
    heads = np.cumsum(size) - size
    first = np.minimum.reduceat(np.where(OPENS[value], byte, len(data)), heads)
    last = np.maximum.reduceat(np.where(CLOSES[value], byte, -1), heads)
    core = (byte >= first[word]) & (byte <= last[word])
    count = np.bincount(word[core] * 9 + CLASS[value[core]], minlength=9 * len(words)).reshape(-1, 9)
    mask = ((count > 0) << np.arange(9)).sum(axis=1)
    digits = np.minimum(count[:, 1], 31)
    check = np.zeros(len(words), np.int64)  # 1: a checksum fails, 2: it holds
    for w in np.flatnonzero((count[:, 1] >= 13) & (count[:, 1] <= 19)):
        check[w] = 1 + _luhn(_digits(data[first[w]:last[w] + 1].tobytes()))
    for w in np.flatnonzero((count[:, 5] == 3) & (mask == (1 << 1 | 1 << 5))):
        parts = data[first[w]:last[w] + 1].tobytes()
        check[w] = 1 + (b".." not in parts and _octets(parts))
    marks = np.minimum(count[:, 5], 7) * 8 + np.minimum(count[:, 6], 3) * 2 + (count[:, 4] > 0)
    length = np.minimum(np.log2(np.maximum(1, last - first + 1)).astype(np.int64), 15)
    opening = CLASS[data[np.minimum(first, len(data) - 1)]]
    active = np.isin(words, trigger)  # the other words of a chain are all alike to their neighbours
    left, right = np.where(active, mask, 0), np.where(active, digits, 0)
    previous = lambda x: np.where(fresh, 0, np.r_[0, x[:-1]])
    following = lambda x: np.where(np.r_[fresh[1:], True], 0, np.r_[x[1:], 0])
    codes = np.stack([mask, digits * 3 + check, marks, length * 9 + opening,
                      previous(left), following(left), previous(right), following(right)], axis=1)
    at = np.flatnonzero(fresh)
    return codes, first, last, np.diff(np.r_[at, len(words)]), docs[at]


def labelled_spans(labels: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(chain, kind, start, end) of the runs of one kind."""
    chain = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.flatnonzero(labels % 2 == 1)
    for w in begins.tolist():
        end = w
        while end + 1 < len(labels) and labels[end + 1] == labels[w] + 1 and chain[end + 1] == chain[w]:
            end += 1
        if last[w] >= first[w] and last[end] >= first[end]:
            yield int(chain[w]), int(labels[w]) // 2, int(first[w]), int(last[end]) + 1


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind each other with a line feed after each, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.cumsum(sizes) - sizes


# ------------------------------------------------------------ training

def examples(marked: str = EXAMPLES) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Texts and their spans in bytes, from lines with ``[kind:...]`` around each span."""
    out = []
    for part in re.split(r"[|\n]", marked.strip()):
        text, spans, at = b"", [], 0
        for m in re.finditer(rf"\[({'|'.join(KINDS)}):([^\]]*)\]", part := part.strip()):
            text += part[at:m.start()].encode()
            spans.append((KINDS.index(m[1]), len(text), len(text) + len(m[2].encode())))
            text += m[2].encode()
            at = m.end()
        out.append((text + part[at:].encode(), spans))
    return out


def label_words(first: np.ndarray, last: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Begin and inside labels of the words whose core overlaps a span."""
    labels = np.zeros(len(first), np.int64)
    for kind, s, e in spans:
        at = np.flatnonzero((first < e) & (last >= s) & (last >= first))
        labels[at] = 2 + 2 * kind
        labels[at[:1]] = 1 + 2 * kind
    return labels


def train(labelled: list[tuple[bytes, list[tuple[int, int, int]], float]]) -> crf.Crf:
    """Fit the field to (text, [(kind, start, end) in bytes], weight) rows."""
    data, doc_starts = _joined([t for t, _, _ in labelled])
    codes, first, last, sizes, docs = chains(data, doc_starts)
    spans = [(k, s + doc_starts[i], e + doc_starts[i]) for i, (_, found, _) in enumerate(labelled) for k, s, e in found]
    labels = label_words(first, last, spans)
    heads = np.cumsum(sizes) - sizes
    weight = np.array([labelled[d][2] for d in docs])
    merged: dict[bytes, list] = {}  # equal chains are one with their weights added
    for h, n, w in zip(heads, sizes, weight):
        key = np.c_[codes[h:h + n], labels[h:h + n]]
        merged.setdefault(key.tobytes(), [key, 0.0])[1] += w
    rows = [k for k, _ in merged.values()]
    both = np.concatenate(rows) if rows else np.zeros((0, len(WIDTHS) + 1), np.int64)
    return crf.fit(both[:, :-1], np.array([len(r) for r in rows], np.int64), both[:, -1],
                   np.array([w for _, w in merged.values()]), WIDTHS)


def label_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 5000) -> list[tuple[bytes, list, float]]:
    """A small labelled table from the documents themselves: ``limit`` chains (at most; those of the least
    hash), each with the spans that the patterns find in it.  Chains of over TRAIN_WORDS words are not drawn."""
    ship_by_value("tilespark.llm.pii"), ship_by_value("tilespark.llm.crf")
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (t for b in batches for t in _groups(b.column(0).to_pylist())):
            data, doc_starts = _joined(texts)
            _, first, last, sizes, _ = chains(data, doc_starts)
            heads = np.cumsum(sizes) - sizes
            out, raw = [], data.tobytes()
            for h, n in zip(heads, sizes):
                lo, hi = first[h:h + n].min(), last[h:h + n].max() + 1
                if n <= TRAIN_WORDS and 0 < hi - lo <= 32 * TRAIN_WORDS:
                    out.append(raw[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["text"])

    cut = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "text binary")
    # equal chains are one row, so that copies do not fill the sample
    drawn = (cut.groupBy("text").count().orderBy(F.xxhash64("text"), "text").limit(limit)).collect()
    return [(bytes(r["text"]), patterns(bytes(r["text"])), 1.0) for r in drawn]


# ------------------------------------------------------------ the operator

def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about CHUNK_BYTES; a text stays whole."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    if spans and not data.isascii():
        place = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        at = lambda i: int(place[i - 1]) if i else 0
    else:
        at = int
    return [{"kind": KINDS[k], "start": at(s), "end": at(e)} for k, s, e in sorted(spans)]


def find_spans(texts: list[bytes], model: crf.Crf) -> tuple[list[list], list[list]]:
    """Spans of the patterns and spans that the field adds, for each text, in code points.
    An added span has a digit or ``@`` and meets no span of the patterns."""
    data, doc_starts = _joined(texts)
    codes, first, last, sizes, docs = chains(data, doc_starts)
    base: list[list] = [[] for _ in texts]
    added: list[list] = [[] for _ in texts]
    for d in np.unique(docs).tolist():
        base[d] = patterns(texts[d])
    labels = crf.viterbi(model, codes, sizes)
    for chain, kind, s, e in labelled_spans(labels, first, last, sizes):
        d = int(docs[chain])
        s, e = s - int(doc_starts[d]), e - int(doc_starts[d])
        if np.isin(CLASS[data[s + doc_starts[d]:e + doc_starts[d]]], [1, 4]).any():
            added[d].append((kind, s, e))
    for d in range(len(texts)):
        if added[d] and base[d]:
            taken = sorted((s, e) for _, s, e in base[d])
            reach = np.maximum.accumulate([e for _, e in taken])  # ends, so far, of spans by start
            begins = [s for s, _ in taken]
            free = lambda s, e: (i := int(np.searchsorted(begins, e))) == 0 or reach[i - 1] <= s
            added[d] = [x for x in added[d] if free(x[1], x[2])]
    return ([_code_points(t, x) for t, x in zip(texts, base)], [_code_points(t, x) for t, x in zip(texts, added)])


def find_private(docs: DataFrame, model: crf.Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``base`` and ``added`` of every row: arrays of (kind, start, end), in code points, end
    exclusive, by kind (email, ip, card, phone), then start.

    ``base`` are the patterns' spans, ``added`` those of the field.  A null or
    empty text has none.  Rows stay as they are (null or repeated ids, equal rows), further columns
    are ignored; an empty table gives no rows.  The work is in proportion to a text's length.
    """
    ship_by_value("tilespark.llm.pii"), ship_by_value("tilespark.llm.crf")
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           *T._parse_datatype_string(f"base {SPANS}, added {SPANS}").fields])
    shared = spark.sparkContext.broadcast(([w.astype(np.float64) for w in model.emit], model.step))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = crf.Crf(*shared.value)
        for b in batches:
            at = 0
            for texts in _groups(b.column(1).to_pylist()):
                base, added = find_spans(texts, own)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(base, span), pa.array(added, span)],
                                                 ["id", "base", "added"])
                at += len(texts)

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def by_kind(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    rank = F.transform(spans, lambda x: F.struct(F.array_position(F.lit(list(KINDS)), x["kind"]).alias("rank"), x["start"].alias("start"),
                                                 x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(rank)
