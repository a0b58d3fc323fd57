"""Every operator on awkward rows against a plain version, and on empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tilespark.llm import decontaminate, language_id, lm_score, simhash, warc_zip
from tilespark.llm.common import crc_mod
from tilespark.llm.components import components
from tilespark.llm.exact_dedup import exact_dedup
from tilespark.llm.line_dedup import line_dedup
from tilespark.llm.source_mix import mix_sources
from tilespark.llm.substring_dedup import substring_dedup
from tilespark.llm.url_filter import RULES, url_filter

#: Names that the operators use inside; as extra columns they must do no harm.
CLASHING = ("id", "h", "norm", "size", "taken", "target", "spans", "items", "n_words", "fp", "slice", "score", "lang_pred",
            "row", "text_sha256", "kept", "salt", "heavy", "version", "window", "start", "component_id", "payload", "digest", "host")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def some_text(rng, n):
    stock = ["the", "of", "Thatblent", "onér", "x1", "and", "Straße", "日本", "re", "hether", "ing", "la"]
    return "".join(rng.choice(stock) + rng.choice([" ", " ", "\n", ", ", "\t", " "]) for _ in range(n))


def rows(distinct_ids=False):
    rng = random.Random(7)
    long_ = some_text(rng, 20_000)
    passage = some_text(rng, 60)
    texts = [None, "", " \n\t", "a", "A", "É é", "one two", "line\nLINE \n line\nline\nline", "\n\n\n\n", long_, long_.upper(), long_[:3000] + "!" + long_[3000:]]
    texts += [some_text(rng, rng.randint(1, 80)) + passage + some_text(rng, rng.randint(0, 30)) for _ in range(12)]
    texts += [some_text(rng, 100)] * 40 + [passage, passage[:49], passage + passage]
    body = [(k, t) for k, t in enumerate(texts)]
    if not distinct_ids:
        body += [(None, None), (None, passage), (None, long_[:500]), (5, some_text(rng, 50)), (5, texts[13]), (13, texts[13]), (13, texts[13])]
    rng.shuffle(body)
    langs, sources = ["en", "fr", None], ["b", "a", None, "É", "B"]
    return [(i, t, rng.choice(langs), rng.choice(sources), len(t or ""), *(str(k) for k in range(len(CLASHING)))) for i, t in body]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def distinct(spark):
    return spark.createDataFrame(rows(True), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def test_short_texts_and_single_lines_are_seen(spark):
    rows = [(1, "one shared line"), (2, "one shared line"), (3, "x\nONE shared line \ny"), (4, "p\n\nq"), (5, "a\np\n\n\nq\n\nb"), (6, "\n\n"), (7, "\n"),
            (None, "a\nb"), (9, "p\n\nz\n\nq")]
    for run in (1, 2, 3):
        got = {r[0]: tuple(r)[1:] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), run=run).collect()}
        assert got == brute.lines(rows, run)
    assert got[6][1] == got[7][1] == 0


def test_line_dedup_rows_that_share_an_id(spark):
    rows = [(1, "a\nb", 0), (1, "a\nb", 1), (1, "b\nc", 2), (None, "a\nd", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int").withColumn("covered", F.lit("x"))
    got = sorted((r["doc_id"] or 9, r["kept_text"]) for r in line_dedup(df).collect())
    # equal rows stay alike; of the two texts of id 1 the one of the smaller hash keeps line b
    assert got in ([(1, "a\nb"), (1, "a\nb"), (1, "c"), (9, "d")], [(1, "a"), (1, "a"), (1, "b\nc"), (9, "d")])


def test_exact_dedup_with_text_ids_and_a_hot_text(spark):
    rows = [(f"d{k:02}", "Same text") for k in range(40)] + [(None, "same text"), ("z", "other"), ("zz", None), ("", "")]
    for keep, best in (("max", "d39"), ("min", "d00")):
        got = exact_dedup(spark.createDataFrame(rows, "doc_id string, text string"), keep=keep).collect()
        same = [r for r in got if r["group_size"] == 41]
        assert len(same) == 41 and {r["keep_id"] for r in same} == {best} and [r["doc_id"] for r in same if r["kept"]] == [best]


def test_line_dedup(docs, distinct, empty):
    want = brute.lines(pairs(distinct))
    got = {r[0]: tuple(r)[1:] for r in line_dedup(distinct).collect()}
    assert got == want and sum(n for _, n, _, _ in want.values()) > 20
    assert line_dedup(docs).count() == docs.count() and line_dedup(empty).count() == 0


def test_url_filter(spark):
    urls = ["http://Example.ORG/es/x?y", "https://example.org/en/1", "http://a.example.org/en/2#z", "https://fr.com/fr/", "http://x.com/de/1",
            "http://notorg/", "http://org", "http://org/", None, "no scheme", "http://", "x://bad.co.uk/a", "x://bad.co.uk/b", "y://u@h:80/p://q", "a\nb://n.org/"]
    pages = spark.createDataFrame([(k, u, "<p>", "h") for k, u in enumerate(urls)] + [(100 + k, f"http://spam.net/{k}", "", "h") for k in range(40)]
                                  + [(200 + k, f"http://good{k % 8}.net/{k}", "", "h") for k in range(80)] + [(None, "http://spam.net/n", None, "h"), (3, "http://twice.org/", "", "h")], "page_id long, url string, html string, host string")
    outcomes = spark.createDataFrame([(100 + k, 1) for k in range(40)] + [(200 + k, 0) for k in range(80)] + [(k, 0) for k in range(7)] + [(None, 1), (2, None), (3, 0)], "page_id long, bad int")
    got = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_filter(pages, outcomes).collect()}
    assert got[0, "example.org", "/es/x"] == ("example.org/es/", "block")
    assert got[1, "example.org", "/en/1"] == ("example.org/en/1", "block")
    assert got[2, "a.example.org", "/en/2"] == ("org/", "allow")
    assert got[3, "fr.com", "/fr/"] == ("com/fr/", "allow") and got[4, "x.com", "/de/1"] == ("com/de/", "block")
    assert got[5, "notorg", "/"][0] is None and got[6, "org", ""][0] is None and got[7, "org", "/"] == ("org/", "allow")
    assert (8, "", "") in got and (9, "", "") in got and (10, "", "") in got
    assert got[13, "u@h:80", "/p://q"][0] is None and got[14, "n.org", "/"] == ("org/", "allow")
    assert all(got[100 + k, "spam.net", f"/{k}"] == (None, "block") for k in range(40)) and got[None, "spam.net", "/n"] == (None, "block")
    assert got[11, "bad.co.uk", "/a"] == (None, "allow") and (3, "twice.org", "/") in got
    assert url_filter(pages.limit(0), outcomes).count() == 0
    assert url_filter(pages, outcomes.limit(0)).where("rule IS NULL AND verdict = 'block'").count() == 0
    assert [len(r) for r in RULES] == [2] * len(RULES)


def test_decontaminate(spark, docs, empty):
    rng = random.Random(3)
    some = [t for _, t in pairs(docs) if t and len(t) > 200]
    items = [("b", some[0][:150]), ("a", " ".join(brute.plain_words(some[1])[5:25])), ("c", "onér X1"), (None, "la la la"), ("d", None), ("e", ""),
             ("a", some[2][10:120]), ("z", some_text(rng, 30))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    short = docs.where("text IS NULL OR length(text) < 20000")
    for words in (1_000_000, 20):  # one block and several
        hits = decontaminate.find_hits(short, bench, block_words=words)
        assert set(hits.columns) == set(docs.columns)
        got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in hits.collect()), key=lambda x: key(x[:3]))
        want = sorted(((i, *brute.hits(t, items)) for i, t in pairs(short)), key=lambda x: key(x[:3]))
        assert got == want
    assert sum(w[2] > 0 for w in want) > 3
    clean = decontaminate.without_hits(hits)
    for r in clean.select("text", F.size("spans").alias("k")).collect():
        assert r["k"] or r["text"] is None or isinstance(r["text"], str)
    gone = sum(1 for w in want if w[2] and w[2] == w[1])
    assert clean.count() == short.count() - gone
    assert decontaminate.find_hits(empty, bench).count() == 0
    assert decontaminate.find_hits(docs, bench.limit(0)).where("size(spans) > 0 OR n_words IS NULL").count() == 0


def test_decontaminate_long_text(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 64)
    rng = random.Random(5)
    texts = [some_text(rng, 200) for _ in range(5)]
    items = [(str(k), t[20:220]) for k, t in enumerate(texts[:3])]
    block = decontaminate.Block([(i, [w.encode() for w in brute.plain_words(t)]) for i, t in items], 10)
    spans, found = [[] for _ in texts], [set() for _ in texts]
    sizes = decontaminate.shard_results(texts, block, spans, found)
    for t, n, s, f in zip(texts, sizes, spans, found):
        assert (n, sum(e - b for b, e in decontaminate.merged(s)), sorted(f)) == brute.hits(t, items)


@pytest.mark.parametrize("split_from", [1 << 13, 1])
def test_substring_dedup(docs, empty, split_from):
    """Also with every anchor of several contexts split into its strings."""
    got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), bytes(r["kept"]))
           for r in substring_dedup(docs, split_from=split_from).collect()]
    want = brute.substrings(pairs(docs))
    assert sorted(got, key=key) == sorted(want, key=key) and sum(w[2] for w in want) > 10_000
    if split_from > 1:
        assert substring_dedup(empty).count() == 0


def test_exact_dedup(docs, distinct, empty):
    for keep, f in (("max", max), ("min", min)):
        want = brute.copies(pairs(distinct), f)
        got = {r[0]: tuple(r)[1:] for r in exact_dedup(distinct, keep=keep).collect()}
        assert got == {i: (k, n, k == i, s) for i, (k, n, s) in want.items()}
        carried = exact_dedup(distinct, keep=keep, carry=True).where("kept").select("row.*")
        assert carried.columns == distinct.columns
        assert sorted(r["doc_id"] for r in carried.collect()) == sorted(i for i, (k, _, _) in want.items() if k == i)
    found = exact_dedup(docs).collect()
    assert len(found) == docs.count()
    groups = {}
    for r in found:
        groups.setdefault(r["text_sha256"], []).append(r)
    for g in groups.values():
        assert sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)}
        ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
        assert {r["keep_id"] for r in g} == {min(ids) if ids else None}
    assert exact_dedup(empty).count() == 0 and exact_dedup(empty, carry=True).count() == 0


def test_exact_dedup_heavy_group(spark):
    """A text with a third of the rows is dealt over several ranges and merged again."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same")).otherwise(F.col("id").cast("string")).alias("text"))
    for keep, best in (("max", 2997), ("min", 0)):
        r = exact_dedup(docs, keep=keep).where(F.col("text_sha256") == brute.sha("same"))
        assert r.select("keep_id", "group_size").distinct().collect() == [(best, 1000)]
        assert [x[0] for x in r.where("kept").select("doc_id").collect()] == [best]


def test_mix_sources(docs, distinct, empty):
    for df in (docs, distinct):
        sized = [(r["doc_id"], r["source"], len(brute.words(r["text"]))) for r in df.select("doc_id", "source", "text").collect()]
        want, target = brute.mix(sized)
        got = mix_sources(df, carry=("source", "size", "taken", "h")).collect()
        assert sorted(((r["doc_id"], r["source"], r["taken"]) for r in got), key=key) == sorted(want, key=key)
        for r in got:
            assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"]
    assert mix_sources(empty).count() == 0
    none = distinct.withColumn("text", F.lit(None).cast("string"))
    assert mix_sources(none).where("taken <> 0 OR target <> 0").count() == 0


def test_mix_sources_cap(spark):
    """A source far below its share stops at three times its size; the others share the rest."""
    docs = spark.createDataFrame([(k, "w " * (1 if s == "b" else 50), s) for k, s in enumerate("a" * 6 + "b" * 3 + "c" * 2)], "doc_id long, text string, source string")
    got = mix_sources(docs).groupBy(F.col("doc_id").between(6, 8).alias("b")).agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    assert got.where("b").first()["t"] == 9 and got.where("b").first()["g"] == 9.0


def test_lm_scores(spark, docs, empty):
    rows_ = pairs(docs)
    train = [brute.crc(i, 10) != 0 for i, _ in rows_]
    import numpy as np

    value = lambda n: float(lm_score.discounted(lm_score.quantised(np.array([n])))[0])
    want, n = brute.lm(rows_, train, value)
    got = lm_score.lm_scores(docs, crc_mod("doc_id", 10) != 0).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got), key=key)
    assert got == sorted(((i, t, k, round(b, 6), round(s, 6)) for (i, _), (t, k, b, s) in zip(rows_, want)), key=key)
    untrained = lm_score.lm_scores(docs, F.lit(False)).where("train_tokens = 0 AND base_score = 0 AND score = 0")
    assert untrained.count() == docs.count() and n > 0
    assert lm_score.lm_scores(empty, F.lit(True)).count() == 0


def test_simhash(docs, empty):
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect()), key=key)
    rows_ = pairs(docs)
    prints = [brute.simhash(t) for _, t in rows_]
    least = brute.linked([i for i, _ in rows_], prints)
    assert got == sorted(((i, p, c) for (i, _), p, c in zip(rows_, prints, least)), key=key)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("split_from", [1 << 14, 3])
def test_simhash_links_dense_groups(spark, monkeypatch, split_from):
    """Chains and balls of fingerprints, also with large top nodes split again."""
    monkeypatch.setattr(simhash, "SPLIT_FROM", split_from)
    monkeypatch.setattr(simhash, "partitions", lambda s: 400)
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for centre in list(prints)[:6]:
        x = centre
        for _ in range(30):
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
            prints.add(x)
        prints |= {centre ^ 1 << rng.randrange(12) ^ 1 << rng.randrange(12) for _ in range(40)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    star = {r["u"] % (1 << 64): r["v"] % (1 << 64) for r in components(simhash.links(nodes, 2)).collect()}
    group = [star.get(p, p) for p in prints]
    want = brute.linked(list(range(len(prints))), prints)
    assert len({*zip(group, want)}) == len(set(group)) == len(set(want))


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (300, 300), (None, 1), (150, 200), (7, 90)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 90: 0, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_language_id(spark, docs, empty):
    words = {"en": "the of and that house water is in".split(), "fr": "le la maison eau que dans est étre".split()}
    rng = random.Random(2)
    rows_ = [(k, " ".join(rng.choices(words[x], k=rng.randint(3, 40))), x) for k, x in enumerate(["en", "fr"] * 60)]
    train = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    model = language_id.train(train, crc_mod("doc_id", 4) != 2)
    got = language_id.identify(train, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 118 and all(0 <= r["score"] <= 1 for r in got)
    told = language_id.identify(docs, model).collect()
    assert len(told) == docs.count() and set(told[0].asDict()) == set(docs.columns)
    for r in told:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert language_id.identify(empty, model).count() == 0
    blank = language_id.train(empty, F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(train, blank).collect()} == {("und", 0.0)}
    odd = spark.createDataFrame([(1, "²³ 12 _ !", "x"), (2, "a" * 100_000, "x"), (3, "中文" * 50, "x")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] == "und" for r in language_id.identify(odd, model).orderBy("doc_id").collect()] == [True, False, False]


def test_language_id_parts(monkeypatch):
    """A long text's parts are cut between words, so the result is that of the whole."""
    monkeypatch.setattr(language_id, "CHARS_AT_ONCE", 50)
    text = " ".join(f"word{k}x" * (1 + k % 9) for k in range(100))
    parts = list(language_id.text_parts(text))
    assert "".join(parts) == text and len(parts) > 5
    assert [w for p in parts for w in language_id.WORD.findall(p)] == language_id.WORD.findall(text)


def test_warc_round_trip(spark, scratch):
    big = "<p>é" + "x" * 300
    rows_ = [(1, "http://a/", "short", "c"), (2, "http://b/ c\r\nd", "short", "c"), (5, None, big, "c"), (3, "u", big, "c"), (9, "v", big, "c"),
             (None, "n", big, "c"), (4, "e", None, "c"), (6, "f", "", "c"), (3, "again", big, "c"), (7, "g", "z" * 200_000 + "\r\n\r\n", "c")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string, package string")
    manifest = warc_zip.write_packages(pages, scratch, package_bytes=500)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows_)
    back = warc_zip.read_packages(manifest).collect()
    got = sorted(((int(r["record_id"]) if r["record_id"] else None, r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"],
                   None if r["payload"] is None else bytes(r["payload"]).decode()) for r in back), key=key)
    want = []
    for i, _, html, _ in rows_:
        h = html or ""
        revisit = h == big and i != 3
        want.append((i, "revisit" if revisit else "response", "3" if revisit else None, brute.sha(h), len(h.encode()), None if revisit else h))
    assert got == sorted(want, key=key)
    assert {r["target_uri"] for r in back if r["record_id"] == "5"} == {None}
    empty = warc_zip.write_packages(pages.limit(0))
    assert empty.count() == 0 and warc_zip.read_packages(empty).count() == 0


def test_warc_without_index(spark, scratch):
    """A foreign package of stored members without an index is read by its gzip members."""
    import gzip
    import zipfile

    records = [warc_zip.record_bytes(str(k), "response", f"http://x/{k}", None, brute.sha(f"p{k}" * 50), len(f"p{k}" * 50), (f"p{k}" * 50).encode()) for k in range(20)]
    with zipfile.ZipFile(f"{scratch}/x.wacz", "w") as z:
        z.writestr("archive/rec-1.warc.gz", b"".join(map(gzip.compress, records[:15])))
        z.writestr("archive/rec-2.warc.gz", b"".join(map(gzip.compress, records[15:])))
        z.writestr("readme.txt", "no record")
    got = warc_zip.read_packages(spark.createDataFrame([(f"{scratch}/x.wacz",)], "package string")).collect()
    assert sorted(int(r["record_id"]) for r in got) == list(range(20))
    assert all(bytes(r["payload"]) == f"p{r['record_id']}".encode() * 50 for r in got)


def test_warc_with_short_index_and_plain_member(spark, scratch):
    """Records that an index does not list, or that stand in an uncompressed member, are read too."""
    import gzip
    import json
    import zipfile

    records = [warc_zip.record_bytes(str(k), "response", f"http://x/{k}", None, brute.sha(f"p{k}" * 50), len(f"p{k}" * 50), (f"p{k}" * 50).encode()) for k in range(12)]
    packed = [gzip.compress(r) for r in records[:8]]
    begin = [sum(map(len, packed[:k])) for k in range(8)]
    entry = lambda k, name: f"- {warc_zip.DATE} " + json.dumps({"offset": str(begin[k]), "length": str(len(packed[k])), "filename": name}) + "\n"
    for index in ("", entry(5, "data.warc.gz") + entry(2, "data.warc.gz") + entry(3, "other.warc.gz"), "".join(entry(k, "data.warc.gz") for k in range(8))):
        with zipfile.ZipFile(f"{scratch}/x.wacz", "w") as z:
            z.writestr("archive/data.warc.gz", b"".join(packed))
            z.writestr("archive/more.warc", b"".join(records[8:]))
            z.writestr("indexes/index.cdxj", index)
        got = warc_zip.read_packages(spark.createDataFrame([(f"{scratch}/x.wacz",)], "package string")).collect()
        assert sorted(int(r["record_id"]) for r in got) == list(range(12))
    with zipfile.ZipFile(f"{scratch}/y.wacz", "w") as z:
        z.writestr("archive/data.arc", "?")
    with pytest.raises(Exception, match="no WARC"):
        warc_zip.read_packages(spark.createDataFrame([(f"{scratch}/y.wacz",)], "package string")).collect()
