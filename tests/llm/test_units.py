"""The operators' building blocks against plain versions."""

import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilespark.llm import decontaminate, language_id, simhash, substring_dedup, url_filter, warc_zip
from tilespark.llm.elias_fano import EliasFano, from_file, to_file
from tilespark.llm.fm_index import FMIndex, suffix_array
from tilespark.llm.lm_score import Shard, discounted, quantised


@given(st.lists(st.integers(0, 5), max_size=60))
@settings(deadline=None, max_examples=60)
def test_suffix_array(x):
    a = np.array(x, np.int64)
    assert suffix_array(a).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("seed", range(4))
def test_fm_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    segments = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(30)]
    segments += [segments[0]] * 5
    symbols = np.concatenate([np.r_[s, 0] for s in segments])
    index = FMIndex(symbols, 3)
    for size in (1, 3, 6):
        phrases = rng.integers(1, 4, (40, size))
        low, high = index.search(phrases)
        for p, lo, hi in zip(phrases, low, high):
            want = [i for i in range(len(symbols) - size + 1) if (symbols[i:i + size] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


@given(st.lists(st.integers(0, 1 << 41), max_size=200), st.lists(st.integers(0, 1 << 41), min_size=1, max_size=50))
@settings(deadline=None, max_examples=60)
def test_elias_fano(values, queries):
    values = sorted(values)
    ef = EliasFano.build(np.array(values, np.int64), (1 << 41) + 1)
    ef = EliasFano(from_file(to_file(ef.arrays)))
    if values:
        assert ef.get(np.arange(len(values))).tolist() == values
    assert ef.successor(np.array(queries)).tolist() == [sum(v < q for v in values) for q in queries]
    found = ef.find(np.array(queries + values))
    for q, i in zip(queries + values, found.tolist()):
        assert (i >= 0) == (q in values) and (i < 0 or values[i] == q)


def test_trie_shard():
    rng = np.random.default_rng(0)
    context = np.unique(rng.integers(0, 1 << 41, 50))
    total = rng.integers(1, 100, len(context))
    pairs = sorted({(int(i), int(w)) for i, w in zip(rng.integers(0, len(context), 300), rng.integers(0, 40, 300) * 977)})
    count = rng.integers(1, 300, len(pairs))
    of, after = map(np.array, zip(*pairs))
    shard = Shard(from_file(to_file(Shard.build(context, total, of, after, count))))
    i = shard.context_of(context)
    assert shard.total(i).tolist() == total.tolist() and shard.fan(i).tolist() == np.bincount(of, minlength=len(context)).tolist()
    grid = [(c, w * 977) for c in range(len(context)) for w in range(45)]
    want = dict(zip(pairs, quantised(count).tolist()))
    got = shard.value(i[[c for c, _ in grid]], np.array([w for _, w in grid]))
    assert got.tolist() == [want.get(g, 0) for g in grid]
    missing = shard.context_of(np.array([-1 + (1 << 41)]))
    assert shard.total(missing).tolist() == [0] and shard.fan(missing).tolist() == [0]
    assert shard.value(missing, np.array([977])).tolist() == [0]


def test_quantised_counts():
    n = np.array([0, 1, 2, 127, 128, 5000, 10 ** 9])
    back = discounted(quantised(n))
    assert back[0] == 0 and back[1] == 0.25 and back[3] == 126.25
    assert np.all(np.abs(back[4:] + 0.75 - n[4:]) <= 0.08 * n[4:])


@given(st.lists(st.binary(min_size=6, max_size=6), min_size=1, max_size=40))
@settings(deadline=None, max_examples=60)
def test_blind_trie(keys):
    keys = [bytes(b % 3 for b in k) for k in keys]
    trie = substring_dedup.BlindTrie(keys[0], 0)
    for i, k in enumerate(keys[1:], 1):
        trie.insert(k, i)
    groups = list(trie.ordered())
    assert [keys[g[0]] for g in groups] == sorted(set(keys))
    assert sorted(i for g in groups for i in g) == list(range(len(keys))) and all(len({keys[i] for i in g}) == 1 for g in groups)


@pytest.mark.parametrize("seed", range(3))
def test_deep_shallow_order(seed):
    rng = np.random.default_rng(seed)
    stock = [bytes(rng.integers(97, 99, 70).astype(np.uint8)) for _ in range(4)]
    contexts, group = [], []
    for g in range(6):
        for _ in range(5):
            s = bytearray(stock[g % 4][:int(rng.integers(50, 70))])
            if rng.random() < 0.6:
                s[int(rng.integers(len(s)))] = 122
            contexts.append(bytes(s)), group.append(g)
    least = rng.integers(0, 100, len(contexts)).tolist()
    got = substring_dedup.least_of_strings(contexts, group, least, 50)
    first = {}
    for c, g, x in zip(contexts, group, least):
        for s in range(len(c) - 49):
            first[g, c[s:s + 50]] = min(first.get((g, c[s:s + 50]), 1000), x)
    for c, g, x in zip(contexts, group, got):
        assert x.tolist() == [first[g, c[s:s + 50]] for s in range(len(c) - 49)]


def test_runs_depend_on_bytes_alone():
    """Equal strings have equal anchors wherever they stand, also in periodic text and across pieces."""
    rng = np.random.default_rng(1)
    shared = bytes(rng.integers(97, 105, 300).astype(np.uint8)) + b"-=" * 60 + b"z" * 80
    docs = [bytes(rng.integers(97, 123, int(rng.integers(0, 200))).astype(np.uint8)) + shared for _ in range(5)] + [b"short"]
    data, ends = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([len(d) for d in docs])
    anchor = {}
    r = substring_dedup.runs(data, ends)
    seen = 0
    for s, w, a in zip(*map(np.ndarray.tolist, r)):
        for k in range(s, s + w):
            seen += 1
            assert anchor.setdefault(data[k:k + 50].tobytes(), a) == a
    assert seen == sum(max(0, len(d) - 49) for d in docs)


@pytest.mark.parametrize("n,most", [(300, 4), (900, 9)])
def test_gray_tree_finds_all_links(n, most):
    rng = np.random.default_rng(n)
    x = np.unique(np.array([0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, most), False))
                            for _ in range(n)], np.uint64))
    rank = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    # groups of 1, 2, 3, ... members and one of all the rest, each in Gray order
    group = np.minimum(np.repeat(np.arange(len(x)), np.arange(1, len(x) + 1))[:len(x)], 12)
    group = np.random.default_rng(0).permutation(group)
    order = np.lexsort([rank, group])
    x, group = x[order], group[order]
    got = [(a, b) for i, j in simhash.linked(x, group, 2, chunk=100) for a, b in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x))
                        if group[i] == group[j] and (int(x[i]) ^ int(x[j])).bit_count() <= 2}
    root = simhash.forest_of(group, x, 2)
    assert all(root[i] == root[j] for i, j in got)


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    names = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "abab"]
    pieces = language_id.piece_tree(names)
    prob = rng.random((len(names) + 1, 2))
    prob[-1] = language_id.OUTSIDE
    model = language_id.Model(["x", "y"], pieces, prob)

    def total(rest):
        if not rest:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(rest) + 1):
            if rest[:n] in names:
                out += prob[names.index(rest[:n])] * total(rest[n:])
        return out if rest[0] in names else out + prob[-1] * total(rest[1:])

    tested = ["a", "abab", "bca", "é", "abababab"]
    assert np.allclose(language_id.forward(tested, model), [np.log(total("▁" + w)) for w in tested])


def test_long_words_are_summed_whole(monkeypatch):
    """A long word's sums and expected pieces, block by block and rescaled, are those of the short way."""
    rng = np.random.default_rng(1)
    names = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "abab", "bbabaab"]
    prob = rng.random((len(names) + 1, 3))
    prob[-1] = language_id.OUTSIDE
    model = language_id.Model(["x", "y", "z"], language_id.piece_tree(names), prob)
    words = ["".join(rng.choice(list("abc"), n)) for n in (1, 3, 9, 17, 24, 24)]
    lang, n = np.array([0, 1, 2, 0, 1, 2]), np.array([3, 1, 2, 5, 1, 4])
    sums, counts = language_id.forward(words, model), np.zeros_like(prob)
    language_id.expected(words, lang, n, model, counts)
    for short, places, step, block in ((0, 4096, 16, 64), (0, 5, 3, 2), (10, 7, 1, 1)):
        for name, value in (("SHORT_WORD", short), ("PLACES_AT_ONCE", places), ("RESCALE", step), ("LANGUAGES_AT_ONCE", block)):
            monkeypatch.setattr(language_id, name, value)
        again = np.zeros_like(prob)
        language_id.expected(words, lang, n, model, again)
        assert np.allclose(language_id.forward(words, model), sums) and np.allclose(again, counts)
    monkeypatch.undo()
    far = language_id.forward(["ab" * 50_000, "ab" * 25_000], model)
    assert np.isfinite(far).all() and np.allclose(far[0], 2 * far[1], rtol=1e-3)


def test_suffix_rules(spark, tmp_path):
    path = tmp_path / "list.dat"
    path.write_text("// names\ncom\nau\ncom.au\n*.ck\n!www.ck\n\nblog.example.com\n公司.cn // end\n", encoding="utf-8")
    rules = url_filter.read_suffix_rules(str(path))
    want = {"a.b.com": ("com", "b.com"), "com": ("com", "com"), "x.y.com.au": ("com.au", "y.com.au"), "a.org": ("org", "a.org"), "": ("", ""),
            "p.q.ck": ("q.ck", "p.q.ck"), "q.ck": ("q.ck", "q.ck"), "ck": ("ck", "ck"), "a.www.ck": ("ck", "www.ck"),
            "a.b.blog.example.com": ("blog.example.com", "b.blog.example.com"), "a.公司.cn": ("公司.cn", "a.公司.cn"),
            "z.a.xn--55qx5d.cn": ("xn--55qx5d.cn", "a.xn--55qx5d.cn"), "a.cn": ("cn", "a.cn"), "..": ("", "." )}
    got = url_filter.with_domains(spark.createDataFrame([(h, 1) for h in want], "host string, n int"), rules).collect()
    assert {r["host"]: (r["suffix"], r["domain"]) for r in got} == want and len(got) == len(want)
    assert url_filter.read_suffix_rules(None) == sorted((x, 2, False) for x in url_filter.TWO_LABEL_SUFFIXES)


def test_beta_below():
    rng = np.random.default_rng(0)
    a = np.r_[0.01, 0.3, 1, 2, 50, 1, 3000, 10 ** rng.uniform(-1, 3, 20)]
    b = np.r_[0.02, 4, 1, 1, 50, 9, 3100, 10 ** rng.uniform(-1, 3, 20)]
    for x in (0.2, 0.5, 0.9):
        got = url_filter.beta_below(a, b, x)
        assert np.allclose(got, 1 - url_filter.beta_below(b, a, 1 - x), atol=1e-12)
        assert got[2] == pytest.approx(x) and got[3] == pytest.approx(x * x) and got[5] == pytest.approx(1 - (1 - x) ** 9)
        for k in range(3, len(a)):  # shapes of at least one half: a plain sum over the density
            if min(a[k], b[k]) >= 0.5:
                t = (np.arange(400_000) + 0.5) / 400_000
                log = (a[k] - 1) * np.log(t) + (b[k] - 1) * np.log1p(-t)
                density = np.exp(log - log.max())
                assert got[k] == pytest.approx(density[t < x].sum() / density.sum(), abs=3e-3)


def test_records_of_all_types():
    def record(kind, block, **more):
        head = {"WARC-Type": kind, "Content-Length": len(block), **{k.replace("_", "-"): v for k, v in more.items()}}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"

    def told(*args, **more):
        r = warc_zip.parse_record(record(*args, **more))
        return r["record_type"], r["payload_digest"], r["payload_bytes"], r["payload"]

    page = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    sha1 = "sha1:VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"  # of abc, in base 32
    sha256 = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert told("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:uuid:1>") == ("warcinfo", None, None, None)
    assert told("request", b"GET / HTTP/1.1\r\n\r\n") == ("request", None, None, None)
    assert told("response", page) == ("response", None, 3, b"abc")
    assert told("response", page.replace(b"Content-Length: 3", b"Server: x")) == ("response", None, 3, b"abc")
    assert told("response", page, WARC_Payload_Digest=sha1) == ("response", sha1, 3, b"abc")
    assert told("response", page, WARC_Payload_Digest="sha256:" + sha256) == ("response", sha256, 3, b"abc")
    assert told("response", page, WARC_Payload_Digest="blake9:zz") == ("response", "blake9:zz", 3, b"abc")
    assert told("resource", b"abc", WARC_Payload_Digest=sha1) == ("resource", sha1, 3, b"abc")
    assert told("revisit", page[:-3], WARC_Payload_Digest=sha1) == ("revisit", sha1, 3, None)
    assert told("revisit", b"") == ("revisit", None, None, None)
    assert told("response", page[:-1], WARC_Truncated="length")[2:] == (2, b"ab")
    assert warc_zip.parse_record(record("warcinfo", b""))["record_id"] is None
    for bad in (page[:-1], page + b"d"):
        with pytest.raises(ValueError, match="damaged"):
            told("response", bad)
    with pytest.raises(ValueError, match="damaged"):
        told("response", page[:-3] + b"abd", WARC_Payload_Digest=sha1)


def test_zip_directories(tmp_path):
    for name, kind, wide in (("a.zip", zipfile.ZIP_STORED, False), ("b.zip", zipfile.ZIP_DEFLATED, False), ("c.zip", zipfile.ZIP_STORED, True)):
        with zipfile.ZipFile(tmp_path / name, "w", kind) as z:
            z.comment = b"PK note"
            for k in range(3):
                with z.open(f"m{k}", "w", force_zip64=wide) as f:
                    f.write(b"x" * k * 10)
        with open(tmp_path / name, "rb") as f:
            found = warc_zip.directory(f, (tmp_path / name).stat().st_size)
            assert list(found) == ["m0", "m1", "m2"]
            with zipfile.ZipFile(tmp_path / name) as z:
                for info in z.infolist():
                    assert found[info.filename] == (info.header_offset, info.compress_size, info.compress_type)
            if kind == zipfile.ZIP_STORED:
                f.seek(warc_zip.member_start(f, found["m2"][0]))
                assert f.read(20) == b"x" * 20


def test_zip64_directory():
    """More entries than the plain record can count, and sizes in the ZIP64 field."""
    import struct

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k in range(65_540):
            z.writestr(zipfile.ZipInfo(f"{k}"), b"")
    assert len(warc_zip.directory(data, data.getbuffer().nbytes)) == 65_540
    extra = struct.pack("<HHQQQ", 1, 24, 5 << 32, 6 << 32, 7 << 32)
    entry = struct.pack("<4s4B4HL2L5H2L", b"PK\x01\x02", 45, 3, 45, 0, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"n" + extra
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, len(entry), 1)
    end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = entry + end64 + locator + end
    assert warc_zip.directory(io.BytesIO(raw), len(raw)) == {"n": (7 << 32, 6 << 32, 0)}


def test_cut_out():
    text = "One, two; THREE four. Five"
    assert decontaminate.cut_out(text, [(1, 3)]) == "One,  four. Five"
    assert decontaminate.cut_out(text, [(0, 1), (4, 5)]) == ", two; THREE four. "
    assert decontaminate.cut_out(text, []) == text
    assert decontaminate.merged([(3, 5), (0, 2), (4, 9), (2, 3)]) == [(0, 9)]
