"""Registered queries over the smallest tables: DuckDB where SQL can say it, else plain versions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm import brute
from tilespark.llm import decontaminate, language_id, lm_score, queries, simhash
from tilespark.llm.components import components

TABLES = "documents pages labels benchmark conversations embeddings".split()


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def sortable(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    r = c.execute(queries.ORACLE[name])
    cols = [d[0] for d in r.description]
    want = [dict(zip(cols, x)) for x in r.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    assert sortable([tuple(value(x[k]) for k in order) for x in df.collect()]) == sortable([tuple(value(x[k]) for k in order) for x in want])


def test_op4(spark, documents):
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op4_suffix_dedup"](spark, SF).collect()}
    assert got == {i: (n, r, s, brute.sha(k)) for i, n, r, s, k in brute.substrings([d[:2] for d in documents])}


def test_op7(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_lm_score"](spark, SF).collect()}
    train = [brute.crc(d[0], 10) != 0 for d in documents]
    value = lambda n: float(lm_score.discounted(lm_score.quantised(np.array([n])))[0])
    want, n = brute.lm([d[:2] for d in documents], train, value)
    for d, on, (tokens, known, base, score) in zip(documents, train, want):
        r = got[d[0]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not on, tokens, known, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the context helps on unseen documents


def test_op8(spark, documents):
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op8_simhash"](spark, SF).collect()}
    prints = [brute.simhash(d[1]) for d in documents]
    least = brute.linked([d[0] for d in documents], prints)
    assert got == {d[0]: (format(p, "016x"), c) for d, p, c in zip(documents, prints, least)}


def test_op8_links_come_from_the_tree(spark, documents, monkeypatch):
    """Every node is searched by its tree, a pair of fingerprints too: without the search no link is left."""
    prints = {brute.simhash(d[1]) for d in documents}  # far from each other, so near ones are added
    prints = sorted(prints | {p ^ 1 << k % 64 ^ 1 << 7 * k % 64 for k, p in enumerate(sorted(prints)) if k % 3})
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    least = brute.linked(list(range(len(prints))), prints)
    star = {r["u"] % (1 << 64): r["v"] % (1 << 64) for r in components(simhash.links(nodes, 2)).collect()}
    group = [star.get(p, p) for p in prints]
    assert len({*zip(group, least)}) == len(set(group)) == len(set(least)) < len(prints)
    monkeypatch.setattr(simhash, "linked", lambda *_: iter(()))
    assert simhash.links(nodes, 2).count() == 0


def test_op9(spark, documents):
    got = {r[0]: r for r in queries.QUERIES["op9_language_id"](spark, SF).collect()}
    assert len(got) == len(documents)
    held = [d for d in documents if brute.crc(d[0], 4) == 2]
    assert {d[0] for d in held} == {i for i, r in got.items() if r["held_out"]}
    assert sum(got[d[0]]["lang_pred"] == d[2] for d in held) >= 0.98 * len(held)


def test_pipeline(spark, documents):
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [tuple(r) for r in corpus_pipeline.STAGES[0][1](spark, table, SF).select("doc_id", "text", "source").collect()]
    clean = {d[0] for d in documents if any(c.isalpha() for c in d[1] or "")}
    assert len(clean - {d[0] for d in docs}) <= 0.01 * len(clean)
    keep = brute.copies([d[:2] for d in docs])
    docs = [d for d in docs if keep[d[0]][0] == d[0]]
    least = brute.linked([d[0] for d in docs], [brute.simhash(d[1]) for d in docs])
    docs = [d for d, c in zip(docs, least) if d[0] == c]
    block = decontaminate.Block([(str(i), [w.encode() for w in brute.plain_words(t)]) for i, t in benchmark], 10)
    left = []
    for i, t, s in docs:
        spans, items = [[]], [set()]
        n = decontaminate.shard_results([t], block, spans, items)[0]
        cut = decontaminate.merged(spans[0])
        assert (n, sum(e - b for b, e in cut)) == brute.hits(t, benchmark)[:2]
        if not cut or sum(e - b for b, e in cut) < n:
            left.append((i, decontaminate.cut_out(t, cut) if cut else t, s))
    assert len(left) < len(documents)
    taken, _ = brute.mix([(i, s, len(brute.words(t))) for i, t, s in left])
    text = {i: t for i, t, _ in left}
    want = sorted((i, text[i], n) for i, _, n in taken if n)
    got = sorted((r["doc_id"], r["text"], r["taken"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_take_awkward_rows(spark):
    rows = [(1, None, None, None, None), (None, "the water of the house", "en", "a", 1), (2, "", "en", None, 0), (3, "12 34", "fr", "a", 5),
            (4, "the water of the house is here", "en", "b", None), (4, "the water of the house is here", "en", "b", None), (5, "THE water of the house is here", None, "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert set(docs.columns) <= set(out.columns)
            got = out.collect()
            assert len(got) <= df.count()
    assert sorted(r["text"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()) == sorted(r[1] for r in rows if r[1] and "the" in r[1].lower())


def test_language_id_matches_plain_version(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=language_id.VOCABULARY)
    names = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if p == "▁" or (q := p.removeprefix("▁")).isalpha() and q == q.lower()]
    rows = [(d, t, x) for d, t, x in ((r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()) if t and x][:24]
    rows += [(-1, "das Rindfleischetikettierungsgesetz am Haus " * 2, "de"), (-2, None, "de"), (-3, "12 ab", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judge = brute.languages([(t, x) for d, t, x in rows if t and x and brute.crc(d, 4) != 2], names, language_id.OUTSIDE)
    got = language_id.identify(docs, language_id.train(docs, (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) != 2)).collect()
    for r in got:
        lang, score = judge(r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)
    assert len(got) == len(rows)


def test_every_sampled_language_is_learned(spark):
    rows = [(k, "the water of the house is here", "en") for k in range(20)] + [(90, "das haus am wasser", "xx"), (91, "la maison", "zz")]
    rows += [(100 + k, f"{chr(97 + k % 26) * 5} {chr(97 + k // 26) * 7}", f"l{k:03}") for k in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert len(model.languages) == 233
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).where("doc_id >= 90").collect()}
    assert got == {r[0]: r[2] for r in rows if r[0] >= 90}


def test_near_stage_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(3)
    a, b, c = (" ".join(f"w{k}" for k in rng.integers(0, 10_000, 60)) for _ in range(3))
    rows = [(1, a, "x"), (1, a, "y"), (1, a, "y"), (2, a, "x"), (1, b, "x"), (0, b, "x"), (None, c, "x"), (None, c, "x"), (7, c, "x"),
            (None, a + " end of it", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    prints = [brute.simhash(r[1]) for r in rows]
    groups = {}
    for r, least in zip(rows, brute.linked(list(range(len(rows))), prints)):
        groups.setdefault(least, []).append(r)
    want = sorted((min((r[0] is None, r[0] or 0) for r in g), {r[1] for r in g}) for g in groups.values())
    got = corpus_pipeline.near(spark, docs, SF).collect()
    assert len(got) == len(groups) and all(tuple(r) in rows for r in got)
    assert sorted((r[0] is None, r[0] or 0) for r in got) == [w[0] for w in want]


def test_language_stage_keeps_short_texts(spark):
    shared = "taxi radio metro"
    rows = [(4 * k + n, f"{shared} {w} {w}", lang, "a", 1) for k in range(8) for n, (w, lang) in enumerate(zip(("der", "the", "les", "gli"), ("de", "en", "fr", "it")))]
    rows += [(100, shared, None, "a", 1), (101, "12 34", None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()} == {r[0] for r in rows} - {101}
    # nothing to learn from: texts with letters pass
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, bare, SF).collect()} == {r[0] for r in rows} - {101}
