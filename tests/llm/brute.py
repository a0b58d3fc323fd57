"""Plain versions of the corpus operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def lines(docs, run=1):
    """docs: (id, text) with distinct ids -> id: (n_lines, n_removed, n_spans, kept text)"""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        raw = (text or "").split("\n")
        norm = [x.strip(" ").translate(AZ) for x in raw]
        full = [k for k, x in enumerate(norm) if x]
        again = set()
        for s in range(len(full) - run + 1):
            key = tuple(norm[k] for k in full[s:s + run])
            if key in seen:
                again |= set(range(s, s + run))
            seen.add(key)
        gone = {full[s] for s in again}
        for s in again:
            if s + 1 in again:
                gone |= set(range(full[s], full[s + 1]))
        out[i] = (len(raw), len(gone), sum(k - 1 not in gone for k in gone), "\n".join(x for k, x in enumerate(raw) if k not in gone))
    return out


def hits(text, items, ngram=10):
    """items: (id, text) -> (n_words, n_hit, sorted item ids)"""
    w = plain_words(text)
    hit, found = set(), set()
    for item, body in items:
        b = plain_words(body)
        n = min(ngram, len(b))
        for s in range(len(b) - n + 1 if n else 0):
            for t in range(len(w) - n + 1):
                if w[t:t + n] == b[s:s + n]:
                    hit |= set(range(t, t + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def substrings(docs, match=50):
    """docs: (id, text) -> list of (id, n_bytes, n_removed, n_spans, kept) in the order given"""
    first = {}
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for s in range(len(b) - match + 1):
            w = b[s:s + match]
            first[w] = min(first.get(w, LAST), i)
    out = []
    for (raw, _), (i, b) in zip(docs, data):
        gone = [False] * len(b)
        for s in range(len(b) - match + 1):
            if first[b[s:s + match]] < i:
                gone[s:s + match] = [True] * match
        out.append((raw, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)),
                    bytes(x for x, g in zip(b, gone) if not g)))
    return out


def copies(docs, keep=max):
    """docs: (id, text) with distinct ids, none null -> id: (keep_id, group_size, sha)"""
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(AZ)].append(i)
    return {i: (keep(g), len(g), sha(t)) for t, g in groups.items() for i in g}


def mix(docs, weights=(1, 2, 3), cap=3):
    """docs: (id, source, size) -> list of (id, source, taken), and the targets"""
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        parts = sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * rest / parts > cap * sizes[s]}
        if not more:
            break
        full |= more
    target = {s: float(cap * sizes[s]) if s in full else weight[s] * rest / parts for s in order}
    out = []
    for s in order:
        budget = math.floor(target[s])
        epochs = budget // sizes[s] if sizes[s] else 0
        left = budget - epochs * sizes[s]
        key = lambda d: (int(hashlib.md5(("" if d[0] is None else str(d[0])).encode()).hexdigest()[:15], 16), d[0] is not None, d[0] or 0, d[2])
        for d in sorted((d for d in docs if d[1] == s), key=key):
            cut = min(d[2], max(0, left))
            left -= cut
            out.append((d[0], s, epochs * d[2] + cut))
    return out, target


def lm(docs, training, value=lambda n: n - 0.75):
    """docs: list of (id, text), training: list of bool -> list of (n_tokens, n_known, base, score), N.
    value: the discounted count as the model stores it"""
    toks = [words(t) + ["\n"] for _, t in docs]
    c, pairs = Counter(), Counter()
    for t, on in zip(toks, training):
        if on:
            c.update(t)
            pairs.update(zip([""] + t, t))
    n, v = sum(c.values()), len(c)
    total, followers = Counter(), Counter()
    for (a, _), k in pairs.items():
        total[a] += k
        followers[a] += 1
    out = []
    for t in toks:
        base = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        score = 0.0
        for a, w, b in zip([""] + t, t, base):
            p = ((value(pairs[a, w]) if (a, w) in pairs else 0) + 0.75 * followers[a] * b) / total[a] if total[a] else b
            score += math.log10(min(1.0, p))
        out.append((len(t), sum(w in c for w in t), sum(map(math.log10, base)), score))
    return out, n


def simhash(text, shingle=3):
    w = words(text)
    parts = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(ids, prints, bits=2):
    """Smallest id reachable over links, for each position (null ids passed over)."""
    root = list(range(len(ids)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[up(i)] = up(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[up(i)] = min(least.get(up(i), x), x)
    return [least.get(up(i)) for i in range(len(ids))]


def repaired(rows):
    """rows: (turn, role, text) of one conversation -> gaps, blank, duplicate, truncated, illegal, cost, audit, sha256"""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, fault = set(), []
    for _, r, x in rows:
        bare = x.rstrip(" \t\n\v\f\r")
        fault.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    grammar = re.compile(r"(s?(ua)+)?")
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {("", ""): (0, "", ())}  # (last initial) -> cost, audit, text; all edits of all rows, row by row

    def offer(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value

    def inserted(now):
        for _ in range(4):
            for (last, _), (c, a, out) in list(now.items()):
                for i, name in (("u", "user"), ("a", "assistant")):
                    if i in follow[last]:
                        offer(now, (i, ""), (c + 5, a + "I", out + ((name, ""),)))

    for (_, r, x), f in zip(rows, fault):
        inserted(best)
        after = {}
        for (last, _), (c, a, out) in best.items():
            offer(after, (last, ""), (c + 2, a + "D", out))
            if f not in ("blank", "duplicate"):
                more = 5 if f == "truncated" else 0
                if r[:1] and r[:1] in follow[last]:
                    offer(after, (r[:1], ""), (c + more, a + "K", out + ((r, x),)))
                for i, name in (("u", "user"), ("a", "assistant")):
                    if i in follow[last]:
                        offer(after, (i, ""), (c + 1 + more, a + "R", out + ((name, x),)))
        best = after
    inserted(best)
    cost, audit, out = min((v for (last, _), v in best.items() if last in ("", "a")), key=lambda v: v[:2])
    assert grammar.fullmatch("".join(r[0] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    gap = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gap, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in out)))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def private(text):
    """[(kind, start, end)] of the fixed patterns, by kind, then start"""
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def clusters(rows, dims, k, rounds, scale=256):
    """rows: (id, vector) -> [(id, cluster, distance)] of the valid ones, and the centroids"""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha("2:" + ("" if r[0] is None else str(r[0]))), r[1]))
    c = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, q)), n) for n, q in enumerate(c))

    for _ in range(rounds):
        group = defaultdict(list)
        for _, v in kept:
            group[near(v)[1]].append(v)
        for n, vs in group.items():
            c[n] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def languages(rows, pieces, outside, rounds=4, prior=0.01):
    """EM over (text, lang) rows; a function from a text to the best language and its posterior."""
    def edges(word):
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                if word[i:j] in place or j == i + 1:
                    yield i, j, place.get(word[i:j], len(place))

    def sums(word, prob):
        a, b = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        every = list(edges(word))
        for i, j, k in every:
            a[j] += a[i] * prob[k]
        for i, j, k in reversed(every):
            b[i] += b[j] * prob[k]
        return a, b, every

    place = {p: k for k, p in enumerate(pieces)}
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    model = {x: [1 / len(place)] * len(place) + [outside] for x in sorted({r[1] for r in rows})}
    seen = {x: Counter(w for t, y in rows if x == y for w in split(t)) for x in model}
    for _ in range(rounds):
        for x, prob in model.items():
            total = [prior] * len(place)
            for w, n in seen[x].items():
                a, b, every = sums("▁" + w, prob)
                for i, j, k in every:
                    if k < len(place):
                        total[k] += n * a[i] * prob[k] * b[j] / a[-1]
            model[x] = [t / math.fsum(total) for t in total] + [outside]

    def judge(text):
        found = split(text or "")
        if not found:
            return "und", 0.0
        each = {x: math.fsum(math.log(sums("▁" + w, prob)[0][-1]) for w in found) for x, prob in model.items()}
        best = max(each, key=each.get)
        return best, 1 / math.fsum(math.exp(v - each[best]) for v in each.values())
    return judge
