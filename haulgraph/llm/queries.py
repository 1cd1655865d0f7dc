"""One query per training-data operator, with production parameters over its whole table, and the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, elkan, filter_audit, license_scan, lm_score, quality_rules, toxicity, url_filter
from .common import table
from .decontam import leaks
from .license_scan import licenses
from .line_dedup import drop_lines
from .shard_map import place
from .piece_codec import encode_documents
from .ngram_join import jaccard_components


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses(docs.select("doc_id", path.alias("path"), "text"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(table(spark, sf_dir, "documents"), model, digests=True)


# The rules of the URL filter's contract.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def fold(of: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"), fold(5) != 1)
    held_out = F.coalesce(fold(5) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.fit(docs, labels.filter(fold(4) != 2), max_docs=400)
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    return toxicity.score(docs, field, spans=False).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


SHARDS = [f"shard-{k:02d}" for k in range(16)]


def op8_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, slots=2053)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents"), max_edits=1, min_words=8)
    return kept.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failure_masks(table(spark, sf_dir, "documents"), F.col("lang"))
    return filter_audit.audit(masks, table(spark, sf_dir, "labels"), filters=5)


def op12_elkan_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.cluster(table(spark, sf_dir, "embeddings"), F.col("embedding"), F.col("vec_id"), k=40, rounds=5)


def op13_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), F.col("source"), most_docs=10, most_per_mille=1, least_left=50)


QUERIES = {
    "op1_additive_quantisation": op1_additive_quantisation,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_url_templates": op5_url_templates,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity_crf": op7_toxicity_crf,
    "op8_shard_table": op8_shard_table,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_elkan_clustering": op12_elkan_clustering,
    "op13_line_frequency": op13_line_frequency,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

_IDF, _RARE, _FORMS = license_scan.templates(license_scan.TEMPLATES, 0.6)
_HASH = "('0x' || substr(md5({}), 1, 12))::BIGINT"

_RUNS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _elkan_sql(k: int, rounds: int) -> str:
    """Rounds of assignments a0, a1, ... to centroids c0, c1, ..., written one after another."""
    square = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        """e AS MATERIALIZED (SELECT row_number() OVER () AS row_key, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM e) WHERE c < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT row_key, vec_id, v, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT row_key, vec_id, v, c, {square} AS d FROM e, c{t}) GROUP BY row_key, vec_id, v)")
        if t < rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{t} o LEFT JOIN (SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS m FROM (
 SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{t}) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return f"""WITH {", ".join(parts)} SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


SQL: dict[str, str] = {
    "op3_license_scan": f"""
WITH t(id, name, n, step, least, whole, ahead) AS (VALUES {", ".join(f"({k}, '{f['name']}', {f['n']}, {f['step']}, {f['least']}::DOUBLE, {f['whole']}, {f['before']})" for k, f in enumerate(_FORMS))}),
m(id, w, must) AS (VALUES {", ".join(f"({k}, '{w}', {must == 'must'})" for k, f in enumerate(_FORMS) for must in ("must", "bars") for w in f[must])}),
known(stated, declared) AS (VALUES {", ".join(f"('{k.lower()}', '{k}')" for k in license_scan.TEMPLATES)}),
v(id, w, x) AS (VALUES {", ".join(f"({k}, '{w}', {x}::DOUBLE)" for k, f in enumerate(_FORMS) for w, x in f["vector"].items())}),
i(w, idf) AS (VALUES {", ".join(f"('{w}', {x}::DOUBLE)" for w, x in _IDF.items())}),
f AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, regexp_extract_all({_LOWER.format("text")}, '[a-z0-9]+') AS words,
 regexp_replace(regexp_extract({_LOWER.format("text")}, '{license_scan.SPDX}', 1), '{license_scan.SPDX_ENDING}', '') AS stated FROM documents),
g AS (SELECT doc_id, path, declared, regexp_replace(path, '/?[^/]*$', '') AS directory, words, coalesce(len(words), 0) AS size FROM f LEFT JOIN known USING (stated)),
p AS (SELECT doc_id, size, unnest(words) AS w, unnest(range(len(words))) AS p FROM g),
q AS (SELECT doc_id, size, w, p, sum(coalesce(idf, {_RARE}::DOUBLE) ** 2) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM p LEFT JOIN i USING (w)),
o AS (SELECT doc_id, id, w, x, p, n, step, size, greatest(0, ceil((size - n) / step))::BIGINT AS last FROM q JOIN v USING (w) JOIN t USING (id)),
k AS (SELECT doc_id, id, w, x, n, step, size, unnest(range(greatest(0, ceil((p - n + 1) / step))::BIGINT, least(last, p // step) + 1)) AS k FROM o),
c AS (SELECT doc_id, id, k, n, step, size, w, any_value(x) AS x, count(*) AS c FROM k GROUP BY doc_id, id, k, n, step, size, w),
d AS (SELECT doc_id, id, k * step AS first, least(k * step + n, size) - 1 AS final, sum(x * idf * sqrt(c)) AS dot FROM c JOIN i USING (w) GROUP BY doc_id, id, k, n, step, size),
z AS (SELECT d.doc_id, d.id, d.first, d.final, t.ahead, round(dot / sqrt(e.run - coalesce(b.run, 0)), 5) AS score
      FROM d JOIN t USING (id) JOIN q e ON e.doc_id = d.doc_id AND e.p = d.final LEFT JOIN q b ON b.doc_id = d.doc_id AND b.p = d.first - 1 WHERE round(dot / sqrt(e.run - coalesce(b.run, 0)), 5) >= least),
x AS (SELECT doc_id, id, p, w, must FROM p JOIN m USING (w)),
y AS (SELECT z.doc_id, z.id, z.first, any_value(z.score) AS score, count(DISTINCT CASE WHEN x.must AND x.p >= z.first THEN x.w END) AS held, count(CASE WHEN NOT x.must THEN 1 END) AS barred
      FROM z LEFT JOIN x ON x.doc_id = z.doc_id AND x.id = z.id AND x.p >= z.first - z.ahead AND x.p <= z.final GROUP BY z.doc_id, z.id, z.first),
n AS (SELECT y.* FROM y LEFT JOIN (SELECT id, count(*) AS asked FROM m WHERE must GROUP BY id) a USING (id) WHERE barred = 0 AND held = coalesce(asked, 0)),
h AS (SELECT doc_id, max(score) AS score, arg_min(name, {{'s': -score, 'm': name, 'n': -n}}) AS own, arg_min({{'n': n, 'whole': whole}}, {{'s': -score, 'm': name, 'n': -n}}) AS inside
      FROM (SELECT n.doc_id, n.score, t.name, t.n, t.whole FROM n JOIN t USING (id)) GROUP BY doc_id),
s AS (SELECT g.doc_id, g.path, directory, coalesce(declared, own) AS own, CASE WHEN declared IS NOT NULL THEN 1 ELSE score END AS score,
      coalesce(declared IS NULL AND inside.whole AND 2 * size <= 3 * inside.n, false) AS licence_file FROM g LEFT JOIN h ON g.doc_id = h.doc_id),
r AS (SELECT directory, arg_min(own, {{'n': -n, 'o': own}}) AS license FROM (SELECT directory, own, count(*) AS n FROM s WHERE licence_file GROUP BY directory, own) GROUP BY directory),
a AS (SELECT a.directory, arg_max(r.directory, length(r.directory)) AS ancestor, arg_max(license, length(r.directory)) AS inherited
      FROM (SELECT DISTINCT directory FROM s) a JOIN r ON a.directory = r.directory OR starts_with(a.directory, r.directory || '/') OR r.directory = '' GROUP BY a.directory)
SELECT doc_id, path, coalesce(own, inherited) AS license, score, licence_file, CASE WHEN own IS NOT NULL THEN 'own' ELSE ancestor END AS origin
FROM s LEFT JOIN a USING (directory)""",
    "op8_shard_table": f"""
WITH RECURSIVE shards AS (SELECT k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS name FROM range(16) t(k)),
orders AS (SELECT k, list_transform(range(2053), lambda i: ({_HASH.format("name || '#offset'")} + i * ({_HASH.format("name || '#skip'")} % 2052 + 1)) % 2053) AS wish FROM shards),
fill(turn, owner) AS (
  SELECT 0, list_transform(range(2053), lambda i: -1)
  UNION ALL
  SELECT turn + 1, list_concat(owner[1:w], [turn % 16], owner[w + 2:])
  FROM (SELECT turn, owner, list_filter(wish, lambda s: owner[s + 1] < 0)[1] AS w FROM fill JOIN orders ON k = turn % 16 WHERE turn < 2053)),
slots AS (SELECT unnest(range(2053)) AS slot, unnest(owner) AS k FROM fill WHERE turn = 2053)
SELECT doc_id, slot::INT AS slot, name AS shard
FROM (SELECT doc_id, {_HASH.format("coalesce(doc_id::VARCHAR, '')")} % 2053 AS slot FROM documents) JOIN slots USING (slot) JOIN shards USING (k)""",
    "op10_line_dedup": f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM split),
w AS (SELECT doc_id, line_no, line, {_WORDS.format("line")} AS words FROM l),
d AS (SELECT words, array_to_string(words, ' ') AS whole, min({{'d': doc_id, 'l': line_no}}) AS first FROM w WHERE len(words) > 0 GROUP BY words),
v AS (SELECT whole, first, i AS place, array_to_string(words[1:i - 1] || words[i + 1:], ' ') AS variant
      FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM d WHERE len(words) >= 8)),
e AS (SELECT variant, place, min(first) AS first FROM v GROUP BY variant, place),
near AS (SELECT v.whole FROM v JOIN e USING (variant, place) WHERE e.first < v.first
         UNION SELECT v.whole FROM v JOIN d ON v.variant = d.whole WHERE len(d.words) >= 8 AND d.first < v.first
         UNION SELECT d.whole FROM v JOIN d ON v.variant = d.whole WHERE len(d.words) >= 8 AND v.first < d.first),
k AS (SELECT w.doc_id, w.line_no, w.line, d.whole IS NOT NULL AND ({{'d': w.doc_id, 'l': w.line_no}} <> d.first OR near.whole IS NOT NULL) AS gone
      FROM w LEFT JOIN d ON w.words = d.words LEFT JOIN near ON near.whole = d.whole),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(kept) AS kept_chars, md5(kept) AS kept_md5
FROM split s LEFT JOIN t ON s.doc_id = t.doc_id""",
    "op11_filter_audit": f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_RUNS.format("coalesce(text, '')")} AS words FROM documents),
f AS (SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x(i, l) AS (VALUES (1, 'A'), (2, 'B'), (4, 'C'), (8, 'D'), (16, 'E')),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS bits, a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e WHERE a.i + b.i + c.i + d.i + e.i = 31 AND len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, k::INT AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) t(k)),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN bad ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
    "op12_elkan_clustering": _elkan_sql(40, 5),
    "op13_line_frequency": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_key, doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS print FROM documents),
w AS (SELECT row_key, {_RUNS.format("t")} AS words FROM d),
p AS (SELECT row_key, unnest(words) AS w, unnest(range(len(words))) AS i FROM w),
g AS (SELECT row_key, i, {" || ' ' || ".join(f"lead(w, {k}) OVER o" for k in range(8))} AS run FROM p WINDOW o AS (PARTITION BY row_key ORDER BY i)),
again AS (SELECT g.row_key, g.i FROM g JOIN (SELECT row_key, run FROM g WHERE run IS NOT NULL GROUP BY row_key, run HAVING count(*) > 1) x ON g.row_key = x.row_key AND g.run = x.run),
r AS (SELECT row_key, count(DISTINCT i + j) AS n FROM again, range(8) t(j) GROUP BY row_key),
l AS (SELECT row_key, source, print, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT row_key, source, print, line, {_RUNS.format("regexp_replace(" + _LOWER.format("line") + ", '[0-9]', '0', 'g')")} AS words FROM l),
k AS (SELECT row_key, source, print, line, array_to_string(words, ' ') AS line_key, len(words) AS n FROM n WHERE len(words) > 0),
u AS (SELECT row_key, count(*) - count(DISTINCT line) AS n FROM k GROUP BY row_key),
c AS (SELECT a.source, line_key FROM (SELECT source, line_key, count(DISTINCT print) AS docs FROM k GROUP BY source, line_key) a JOIN (SELECT source, count(DISTINCT print) AS whole FROM d GROUP BY source) b ON a.source IS NOT DISTINCT FROM b.source
      WHERE docs > 10 AND docs * 1000 > whole),
z AS (SELECT row_key, sum(n) AS n FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.line_key = c.line_key GROUP BY row_key),
s AS (SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(z.n, 0)::BIGINT AS n_lost_words
      FROM d JOIN w USING (row_key) LEFT JOIN u USING (row_key) LEFT JOIN r USING (row_key) LEFT JOIN z USING (row_key))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_lost_words) >= 50 * n_words AS kept FROM s""",
}
