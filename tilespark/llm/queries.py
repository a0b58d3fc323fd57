"""Registered queries of the corpus operators and their DuckDB SQL.

A query reads whole tables, calls its operator, and derives its columns from
the operator's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import centroids, decontaminate, language_id, pii, repair, simhash, warc_zip
from tilespark.llm.common import crc_mod, stored
from tilespark.llm.exact_dedup import exact_dedup
from tilespark.llm.line_dedup import line_dedup
from tilespark.llm.lm_score import lm_scores
from tilespark.llm.source_mix import mix_sources
from tilespark.llm.substring_dedup import substring_dedup
from tilespark.llm.url_filter import RHO_LEAST, RHO_MOST, RULES, read_suffix_rules, url_filter

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


# ------------------------------------------------------------ op2

def _sql_rules() -> tuple[str, str]:
    rule, action = [], []
    for act, text in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"
        rule.append(f"WHEN {fits} THEN '{text}'")
        action.append(f"WHEN {fits} THEN '{act}'")
    return f"CASE {' '.join(rule)} END", f"CASE {' '.join(action)} END"


def _sql_strength(name: str, groups: str, parent: str) -> str:
    return f"""
{name}_up AS (SELECT {parent}, sum(n) m, sum(bad) x, count(*) k, sum(n * n) nn, sum(bad * bad / n::DOUBLE) xx
  FROM {groups} WHERE n > 0 GROUP BY {parent}),
{name}_sums AS (SELECT sum(xx - x * x / m::DOUBLE) sb, sum(x - xx) sw, coalesce(sum(k - 1), 0) fb,
  coalesce(sum(m - k), 0) fw, sum(m - nn / m::DOUBLE) sp FROM {name}_up),
{name} AS (SELECT CASE WHEN fb = 0 THEN 1 / {RHO_LEAST} - 1 WHEN fw = 0 THEN 1 / {RHO_MOST} - 1
  ELSE 1 / least({RHO_MOST}, greatest({RHO_LEAST}, CASE WHEN sb / fb + (sp / fb - 1) * sw / fw > 0
    THEN (sb / fb - sw / fw) / (sb / fb + (sp / fb - 1) * sw / fw) ELSE {RHO_LEAST} END)) - 1 END::DOUBLE k FROM {name}_sums)"""


_RULE, _ACTION = _sql_rules()
#: The public suffixes, the same in the query and its SQL.
SUFFIX_RULES = read_suffix_rules()
_SUFFIXES = ", ".join(f"('{name}', {width}, {100 * won + width})" for name, width, won in SUFFIX_RULES)
_MOST_LABELS = max(name.count(".") + 1 for name, _, _ in SUFFIX_RULES)
OP2_SQL = rf"""
WITH urls AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), {AZ}) host,
  regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) path FROM pages),
outcomes AS (SELECT doc_id page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) bad FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id),
counts AS (SELECT host, count(bad) n, coalesce(sum(bad), 0)::BIGINT bad, string_split(host, '.') l
  FROM urls LEFT JOIN outcomes USING (page_id) GROUP BY host),
known (name, width, rank) AS (VALUES {_SUFFIXES}),
met AS (SELECT host, arg_max(width, rank) w FROM counts, unnest(range(1, least(len(l), {_MOST_LABELS}) + 1)) AS r(k)
  JOIN known ON name = array_to_string(l[-k:], '.') AND width <= len(l) GROUP BY host),
cut AS (SELECT counts.*, coalesce(w, 1) w FROM counts LEFT JOIN met USING (host)),
hosts AS (SELECT host, n, bad, array_to_string(l[-w:], '.') suffix, array_to_string(l[-(w + 1):], '.') AS domain, 0 AS everything FROM cut),
domains AS (SELECT domain, suffix, sum(n)::BIGINT n, sum(bad)::BIGINT bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, everything, sum(n)::BIGINT n, sum(bad)::BIGINT bad FROM hosts GROUP BY suffix, everything),
{_sql_strength('ks', 'suffixes', 'everything')},
{_sql_strength('kd', 'domains', 'suffix')},
{_sql_strength('kh', 'hosts', 'domain')},
root AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) p FROM hosts),
s AS (SELECT suffix, (bad + ks.k * p) / (n + ks.k) sm FROM suffixes, ks, root),
d AS (SELECT domain, suffix, (bad + kd.k * sm) / (n + kd.k) dm FROM domains JOIN s USING (suffix), kd),
h AS (SELECT host, n, kh.k, (bad + kh.k * dm) / (n + kh.k) hm FROM hosts JOIN d USING (domain, suffix), kh),
u AS (SELECT host, (n + k) * hm x, (n + k) * (1 - hm) y, n + k z FROM h),
v AS (SELECT host, x, y, greatest(x, y) a, least(x, y) b, z FROM u),
i AS (SELECT host, x, y, list_sum(list_transform(range(0, (100 + 20 * sqrt(z))::BIGINT),
  lambda j: exp(lgamma(z + j) - lgamma(a + 1 + j) - lgamma(b) + (z + j) * ln(0.5)))) p FROM v),
b AS (SELECT host, CASE WHEN x < y THEN 1 - p ELSE p END below FROM i)
SELECT page_id, host, path, {_RULE} AS rule,
  coalesce({_ACTION}, CASE WHEN below < 0.05 THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN b USING (host)"""


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the label of the document with its id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"),
                             F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_filter(table(spark, sf_dir, "pages"), outcomes, suffix_rules=SUFFIX_RULES)


# ------------------------------------------------------------ op5

OP5_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {AZ}) t FROM documents),
g AS (SELECT t, max(doc_id) keep_id, count(*) group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""


@query("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


# ------------------------------------------------------------ op6

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT k FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, total - coalesce(sum(3 * source_size) OVER f, 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS parts FROM w
  WINDOW f AS (ORDER BY source_size / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w * rest / parts::DOUBLE > 3 * source_size AS capped FROM o),
free AS (SELECT max(total) - coalesce(sum(CASE WHEN capped THEN 3 * source_size END), 0) AS rest,
  sum(CASE WHEN capped THEN 0 ELSE w END) AS parts FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE w * free.rest / free.parts::DOUBLE END AS target
  FROM c, free),
b AS (SELECT source, source_size, target, floor(target)::BIGINT AS budget,
  CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(size, greatest(0, budget - epochs * source_size - start)))::BIGINT AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source"""


@query("op6_source_mix", OP6_SQL)
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------ op9

@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.train(docs, ~held_out)
    return (language_id.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


# ------------------------------------------------------------ op8

@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


# ------------------------------------------------------------ op10

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT payload_bytes, sha256(h) payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""


@query("op10_warc", OP10_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = warc_zip.read_packages(warc_zip.write_packages(pages), payloads=False)
    return back.select(F.col("record_id").try_cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").try_cast(kind).alias("refers_to"))


# ------------------------------------------------------------ op1

OP1_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) a FROM documents),
l AS (SELECT doc_id, i, translate(trim(a[i]), {AZ}) x FROM d, unnest(range(1, len(a) + 1)) AS r(i)),
b AS (SELECT doc_id, i, x, row_number() OVER w j, lead(i) OVER w following FROM l WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT x, min((doc_id, i)) first_place FROM b GROUP BY x HAVING count(*) > 1),
e AS (SELECT doc_id, i, CASE WHEN lead(j) OVER (PARTITION BY doc_id ORDER BY j) = j + 1 THEN following ELSE i + 1 END over_at
  FROM b JOIN f USING (x) WHERE (doc_id, i) > first_place),
c AS (SELECT doc_id, k AS i FROM e, unnest(range(i, over_at)) AS r(k)),
g AS (SELECT doc_id, count(*) n_removed, count(*) FILTER (i - 1 IS DISTINCT FROM before) n_spans, list(i) gone
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) before FROM c) GROUP BY doc_id)
SELECT doc_id, len(a)::BIGINT n_lines, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN a ELSE
    list_filter(a, lambda x, i: NOT list_contains(gone, i)) END, chr(10))) kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


@query("op1_line_dedup", OP1_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", "n_spans",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


# ------------------------------------------------------------ op3

OP3_SQL = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
p AS (SELECT DISTINCT item_id, w[s:s + least(len(w), {decontaminate.NGRAM}) - 1] k
  FROM b, unnest(range(1, greatest(len(w) - {decontaminate.NGRAM - 2}, 2))) AS r(s) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
n AS (SELECT DISTINCT len(k) n FROM p),
h AS (SELECT doc_id, s, n, w[s:s + n - 1] k FROM d, n, unnest(range(1, len(w) - n + 2)) AS r(s)),
m AS (SELECT doc_id, s, n, item_id FROM h JOIN p USING (k)),
c AS (SELECT doc_id, count(DISTINCT s + o) n_hit FROM m, unnest(range(n)) AS r(o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""


@query("op3_decontaminate", OP3_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return (hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


# ------------------------------------------------------------ op4

OP4_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) b FROM documents),
w AS (SELECT doc_id, s, b[s:s + 49] k FROM d, unnest(range(1, octet_length(b) - 48)) AS r(s)),
f AS (SELECT k, min(doc_id) first_id FROM w GROUP BY k HAVING count(*) > 1),
u AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER o + 50 THEN 0 ELSE 1 END fresh FROM w JOIN f USING (k)
  WHERE first_id < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
n AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) span FROM u),
p AS (SELECT doc_id, span, min(s) first_byte, max(s) + 49 last_byte FROM n GROUP BY doc_id, span),
q AS (SELECT *, coalesce(lag(last_byte) OVER (PARTITION BY doc_id ORDER BY first_byte), 0) before FROM p),
g AS (SELECT doc_id, sum(last_byte - first_byte + 1)::BIGINT n_removed, count(*) n_spans, max(last_byte) over_at,
  string_agg(substr(hex(b), 2 * before + 1, 2 * (first_byte - 1 - before)), '' ORDER BY first_byte) kept
  FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans,
  sha256(CASE WHEN over_at IS NULL THEN b ELSE unhex(kept || substr(hex(b), 2 * over_at + 1)) END) kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


@query("op4_suffix_dedup", OP4_SQL)
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------------ op7

@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lm_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)
    return done.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# ------------------------------------------------------------ op13

CLUSTERS, ROUNDS = 40, 5


def _sql_rounds() -> str:
    """A round: every vector's nearest centroid, then the floors of the means; empty centroids stay."""
    near = """a{i} AS (SELECT r, any_value(vec_id) vec_id, any_value(v) v, min((d, c)) m FROM
  (SELECT r, vec_id, p.v, c, list_sum(list_transform(range(1, 65), lambda j: (p.v[j] - q.v[j]) * (p.v[j] - q.v[j])))::BIGINT d
   FROM p, c{i} q) GROUP BY r)"""
    mean = """s{i} AS (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY j) v FROM
  (SELECT m[2] c, j, sum(v[j])::BIGINT s, count(*) n FROM a{i}, unnest(range(1, 65)) AS t(j) GROUP BY ALL) GROUP BY c),
c{k} AS (SELECT c, coalesce(s.v, q.v) v FROM c{i} q LEFT JOIN s{i} s USING (c))"""
    parts = [x for i in range(ROUNDS) for x in (near.format(i=i), mean.format(i=i, k=i + 1))]
    return ",\n".join([*parts, near.format(i=ROUNDS)])


OP13_SQL = f"""
WITH p AS (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM
  (SELECT v, sha256('2:' || coalesce(vec_id::VARCHAR, '')) h FROM p ORDER BY h, v LIMIT {CLUSTERS})),
{_sql_rounds()}
SELECT vec_id, m[2]::INT AS cluster, m[1] distance, sum(m[1]) OVER (PARTITION BY m[2])::BIGINT cluster_inertia,
  sum(m[1]) OVER ()::BIGINT inertia, sha256(array_to_string(q.v, ',')) centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} q ON q.c = m[2]"""


@query("op13_centroid_clusters", OP13_SQL)
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=CLUSTERS, rounds=ROUNDS)
    near = stored(found.vectors, "clusters")
    sums = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row for each centroid at most
    total = sum(r["cluster_inertia"] for r in sums)
    rows = [(r["cluster"], r["cluster_inertia"], total, ",".join(map(str, found.centroids[r["cluster"]]))) for r in sums]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string")
    return (near.join(F.broadcast(told), "cluster")
            .select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                    F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256")))


# ------------------------------------------------------------ op12

@query("op12_private_data")
def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the hash are those of the patterns' spans; ``spans`` has the added ones too."""
    docs = table(spark, sf_dir, "documents")
    known = [(text, spans, pii.EXAMPLE_WEIGHT) for text, spans in pii.examples()]
    found = pii.find_private(docs, pii.train(known + pii.label_windows(docs)))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts,
                        F.sha2(pii.joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.joined_spans(pii.by_kind(F.concat("base", "added"))).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


# ------------------------------------------------------------ op11

def _sql_walk() -> tuple[str, str, str, str, str, str]:
    """The least (cost, audit) to each state, a row at a time: insertions first, then the row's edit.
    A state that cannot be reached costs a billion."""
    add = lambda x, c, e: f"{{'c': {x}.c + {c}, 'a': {x}.a || {e}}}"
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    u = least("w.u", add("w.h", 5, "'I'"), add("w.s", 5, "'I'"), add("w.a", 5, "'I'"))
    a = least("w.a", add("w.u", 5, "'I'"), add("w.h", 10, "'II'"), add("w.s", 10, "'II'"))
    put = lambda x, i: add(x, f"CASE WHEN fault IN (1, 2) THEN 1000000000 ELSE 5 * (fault = 3)::INT + CASE WHEN initial = '{i}' THEN 0 ELSE 1 END END",
                           f"CASE WHEN initial = '{i}' THEN 'K' ELSE 'R' END")
    drop = lambda x: add(x, 2, "'D'")
    system = add("w.h", "CASE WHEN fault IN (1, 2) OR initial <> 's' THEN 1000000000 ELSE 5 * (fault = 3)::INT END", "'K'")
    return (u, a, drop("w.h"), least(drop("w.s"), system), least(drop("x.u"), put("w.h", "u"), put("w.s", "u"), put("x.a", "u")),
            least(drop("x.a"), put("x.u", "a")))


_U, _A, _NEXT_H, _NEXT_S, _NEXT_U, _NEXT_A = _sql_walk()
_FAR = "{'c': 1000000000, 'a': ''}"
OP11_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) step),
k AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') t,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 20 h FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END t
  FROM k, unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END))),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) i FROM d),
r AS (SELECT *, left(role, 1) initial, regexp_extract(t, '([^ 	-
])[ 	-
]*\z', 1) tail, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) before,
  row_number() OVER (PARTITION BY conv_id, role, t ORDER BY i) occurrence, count(*) OVER (PARTITION BY conv_id) rows FROM n),
f AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN occurrence > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END fault FROM r),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT gaps, count(*) FILTER (fault = 1) blank,
  count(*) FILTER (fault = 2) duplicate, count(*) FILTER (fault = 3) truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) illegal FROM f GROUP BY conv_id),
w AS (SELECT DISTINCT conv_id, 0::BIGINT i, rows, {{'h': {{'c': 0, 'a': ''}}, 's': {_FAR}, 'u': {_FAR}, 'a': {_FAR}}} w FROM f
  UNION ALL SELECT conv_id, i, rows, {{'h': {_NEXT_H}, 's': {_NEXT_S}, 'u': {_NEXT_U}, 'a': {_NEXT_A}}} FROM
  (SELECT f.conv_id, f.i, f.rows, f.fault, f.initial, w.w, {{'u': {_U}, 'a': {_A}}} x FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
e AS (SELECT conv_id, list_sort([w.h, {_A}])[1] e FROM w WHERE i = rows),
o AS (SELECT conv_id, e.c "cost", e.a audit, unnest(range(1, length(e.a) + 1)) p FROM e),
l AS (SELECT conv_id, p, substr(audit, p, 1) edit, sum((substr(audit, p, 1) <> 'I')::INT) OVER b i,
  sum((substr(audit, p, 1) <> 'D')::INT) OVER b m, sum((substr(audit, p, 1) <> 'D')::INT) OVER (PARTITION BY conv_id) total
  FROM o WINDOW b AS (PARTITION BY conv_id ORDER BY p)),
t AS (SELECT l.conv_id, l.p, CASE WHEN edit = 'K' THEN f.role WHEN (total - m) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' ||
  CASE WHEN edit = 'I' THEN '' ELSE f.t END line FROM l JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = greatest(l.i, 1) WHERE edit <> 'D'),
s AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) body FROM t GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, coalesce(e.c, 0)::BIGINT AS "cost", coalesce(e.a, '') audit, sha256(coalesce(body, '')) repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id"""


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped, emptied, stripped of
    its full stops, repeated, or given to the user.  A null counts as one space."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(words("text"), "[.!?]", "")).otherwise(words("text"))
    times = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return (turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(words("role")).alias("role"), text.alias("text"),
                         F.explode(F.array_repeat(F.lit(1), times)).alias("one")).drop("one"))


@query("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    fixed = repair.repair_conversations(damaged(turns))
    told = fixed.conversations.withColumnRenamed("id", "id1")
    hashes = repair.digests(fixed.rows).withColumnRenamed("id", "id2")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    # an id whose rows were all dropped has a row here alone
    return (turns.select("conv_id").distinct()
            .join(told, F.col("conv_id").eqNullSafe(F.col("id1")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("id2")), "left")
            .select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
