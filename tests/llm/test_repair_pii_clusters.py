"""Conversation repair, private data and centroid clustering against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import brute
from tilespark.llm import centroids, crf, pii, queries, repair

TURNS = "conv_id long, turn long, role string, text string"


def talk(seed, n, conv=1):
    r = random.Random(seed)
    texts = ["", " \n", "Hi.", "Hi", "Yes!", "no", "Why?\t", None, "a.b", "x."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ape", "System"]
    return [(conv, r.choice([None, *range(n)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


def mended(spark, rows, **more):
    done = repair.repair_conversations(spark.createDataFrame(rows, TURNS), **more)
    told = {r["id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) for r in done.conversations.collect()}
    sha = {r["id"]: r["sha256"] for r in repair.digests(done.rows).collect()}
    assert set(told) == set(sha)
    return {i: (*told[i], sha[i]) for i in told}


def plain(rows):
    return {c: brute.repaired([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_repair_agrees_with_plain_version(spark):
    rows = [x for c in range(40) for x in talk(c, 1 + c % 13, c)] + [(None, 1, "user", "a?"), (None, 0, "system", "Be.")]
    random.Random(5).shuffle(rows)
    assert mended(spark, rows) == plain(rows)


def test_long_conversations_are_joined_from_pieces(spark):
    """One conversation with most rows, pieces of three rows and more than one level of joins."""
    rows = talk(1, 900) + [x for c in range(2, 9) for x in talk(c, 9, c)] + [(1, 7, "user", "Hi.")] * 500
    assert mended(spark, rows, piece_rows=3) == plain(rows)


def test_repair_of_nothing_and_of_equal_rows(spark):
    assert mended(spark, []) == {}
    rows = [(4, None, None, None)] * 3 + [(5, 0, "user", "Hi.")] * 50 + [(6, 2, "user", "Long. " * 300_000), (6, 3, "assistant", "Ok.")]
    assert mended(spark, rows) == plain(rows)


def test_extra_columns_and_text_ids(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi.", 1, 2), ("a", 1, "assistant", "Ho.", 1, 2)],
                               "conv_id string, turn int, role string, text string, part int, id int")
    done = repair.repair_conversations(df)
    assert [(r["id"], r["cost"], r["audit"]) for r in done.conversations.collect()] == [("a", 0, "KK")]


def test_joined_solutions_equal_one_solution():
    for seed in range(60):
        rows, _ = repair.with_faults([(t, r or " ", x or " ", 1) for _, t, r, x in talk(seed, 12)])
        cut = random.Random(seed).randrange(1, 12)
        whole = repair.solve_all(rows)
        assert repair.joined([repair.solve_all(rows[:cut]), repair.solve_all(rows[cut:])]) == whole
        ends = repair.solve(rows, repair.HEAD, only_ends=True)
        assert min(ends.values()) == min(w for (s, e), w in whole.items() if s == repair.HEAD and e in repair.ENDS)


# ------------------------------------------------------------ private data

@pytest.fixture(scope="module")
def field():
    return pii.train([(t, s, 1.0) for t, s in pii.examples()])


NASTY = ["", None, "a@b.c", "a@b.c@d.e", "@x.y", "..@-.-", "x+y%z@host.example.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256",
         "0000000001.2.3.4", "4111 1111-1111 1111", "4111  1111", "41111111111111114111111111111111", "+49 (0)30 5550143-", "+1", "+1-",
         "é +49 171 5550143 ü a.b@ç.de a@b", "4111111111111111\n4111111111111112", "+1 (2) 3", "a@b-.c--d!", "1 2 3 4 5 6 7 8 9 0 1 2 3 4"]


def test_patterns_are_those_of_the_regular_expressions(field):
    r = random.Random(3)
    texts = NASTY + ["".join(r.choice("0123456789.-+ @()ax%é") for _ in range(r.randrange(120))) for _ in range(800)]
    texts += [" ".join(r.choice(["4111111111111111", "1.2.3.4", "+1 (23) 456-7890", "a@b.cd", "word", "12", "-"]) for _ in range(20)) for _ in range(50)]
    base, added = pii.find_spans([(t or "").encode() for t in texts], field)
    for t, found, more in zip(texts, base, added):
        assert [(x["kind"], x["start"], x["end"]) for x in found] == brute.private(t)
        for x in more:  # an added span is new, and looks at something
            assert not any(s < x["end"] and x["start"] < e for _, s, e in brute.private(t)) and re.search("[0-9@]", t[x["start"]:x["end"]])


def test_patterns_take_linear_time(field):
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "+1" + "(" * 300_000, "a@" * 200_000, "1 " * 200_000):
        pii.patterns(t.encode())


def test_field_learns_other_forms(field):
    for text, (kind, part) in {"write to kim@uni now": ("email", "kim@uni"), "call 415-555-2671 now": ("phone", "415-555-2671"),
                               "or (415) 555-2671 then": ("phone", "(415) 555-2671"), "card 4000.1234.5678.9010 is": ("card", "4000.1234.5678.9010")}.items():
        ((found,),) = pii.find_spans([text.encode()], field)[1]
        assert (found["kind"], text[found["start"]:found["end"]]) == (kind, part)
    for text in ("on 2023-05-06 it", "id 123456789 is", "chapter 7 of 12", "no numbers here", "at 08:15:00 we", "version 2.10.3 of"):
        assert pii.find_spans([text.encode()], field)[1] == [[]]


def test_viterbi_and_sums_by_enumeration():
    import itertools
    rng = np.random.default_rng(0)
    model = crf.Crf([rng.normal(size=(4, crf.LABELS)), rng.normal(size=(3, crf.LABELS))], rng.normal(size=(crf.LABELS, crf.LABELS)) + crf.allowed_steps())
    sizes = np.array([1, 3, 2])
    codes = np.stack([rng.integers(0, 4, 6), rng.integers(0, 3, 6)], axis=1)
    emit, got, at, total = crf.scores(model, codes), crf.viterbi(model, codes, sizes), 0, 0.0
    for n in sizes:
        ways = {y: sum(emit[at + t, y[t]] for t in range(n)) + sum(model.step[a, b] for a, b in zip((0, *y), (*y, 0)))
                for y in itertools.product(range(crf.LABELS), repeat=int(n))}
        assert tuple(got[at:at + n]) == max(ways, key=ways.get)
        total += np.log(sum(np.exp(v) for v in ways.values()))
        at += n
    z, words, steps = crf.expected(model, codes, sizes, np.ones(3))
    assert z == pytest.approx(total) and words.sum(axis=1) == pytest.approx(1) and steps.sum() == pytest.approx(6 + 3)


def test_private_data_table(spark, field):
    rows = [(i % 5 or None, t, "x") for i, t in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = pii.find_private(df, field).collect()
    key = lambda i, s: (i is None, i or 0, s)
    assert sorted((key(r["id"], [tuple(x) for x in r["base"]]) for r in got)) == sorted(key(i, brute.private(t)) for i, t, _ in rows)
    assert pii.find_private(df.limit(0), field).collect() == []
    assert pii.train([]).step.shape == (crf.LABELS, crf.LABELS)
    assert pii.label_windows(df.limit(0)) == []


def test_op12(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_private_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute.private(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert r["base_sha256"] == brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in want))
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert {(k, str(s), str(e)) for k, s, e in want} <= set(spans) and len(spans) == len(want) + r["n_added"]
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))


# ------------------------------------------------------------ clusters

def vectors(seed, n, dims):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, dims))
    return [(int(i), [float(x) for x in np.float32(middle[i % 6] + 0.1 * r.normal(size=dims))]) for i in range(n)]


@pytest.mark.parametrize("dims,block", [(4, 8), (64, 512)])
def test_clusters_agree_with_plain_version(spark, dims, block):
    rows = vectors(dims, 150, dims) + [(7, [0.5] * dims)] * 40 + [(None, [0.25] * dims), (900, None), (901, [1.0] * (dims - 1)),
                                                               (902, [float("nan")] * dims), (903, [None] * dims), (904, [float("inf")] + [0.0] * (dims - 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x"))
    got = centroids.cluster_vectors(df, dims=dims, k=12, rounds=3, block_rows=block)
    want, c = brute.clusters(rows, dims, 12, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert got.centroids == c and sorted(map(tuple, got.vectors.collect()), key=key) == sorted(want, key=key)


def test_clusters_of_nothing_and_of_few(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(df.limit(0), dims=2).vectors.collect() == []
    assert [tuple(r) for r in centroids.cluster_vectors(df, dims=2).vectors.collect()] == [(1, 0, 0)]
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>"), dims=2).vectors.collect()


def test_large_components_are_exact():
    r = np.random.default_rng(1)
    v, c = r.integers(-centroids.MOST + 1, centroids.MOST, (50, 64)), r.integers(-centroids.MOST + 1, centroids.MOST, (5, 64))
    best, d = centroids.nearest(v, c, np.arange(5))
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, q)), k) for k, q in enumerate(c)) for x in v]
    assert [(int(a), int(b)) for a, b in zip(d, best)] == want
    assert (centroids.from_bytes(centroids.to_bytes(v).tobytes(), 64) == v).all()


def test_hilbert_curve_goes_through_neighbours():
    """In curve order, neighbouring cells of a full square grid differ by one step."""
    v = np.array([(x, y) for x in range(16) for y in range(16)], np.int64)
    keys = centroids.hilbert_keys(v, 0, 15, bits=4)
    walk = v[sorted(range(len(v)), key=lambda i: keys[i])]
    assert len(set(keys)) == 256 and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_out_far_centroids():
    r = np.random.default_rng(2)
    lo = r.integers(0, 50, 8)
    hi = lo + 5
    c = r.integers(0, 60, (200, 8))
    found = set(centroids.candidates(lo, hi, c).tolist())
    inside = r.integers(lo, hi + 1, (3000, 8))
    near, _ = centroids.nearest(inside, c, np.arange(200))
    assert set(near.tolist()) <= found and len(found) < 100
