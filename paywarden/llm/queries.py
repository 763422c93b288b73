"""The registered queries of the text operators, each over its whole table, and SQL forms where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, binary, collocations, decontaminate, fingerprints, jaccard, language, packing, pii, quality, repeats, toxicity, urls
from .common import held_out, read

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    out = held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, read(spark, folder, "labels"), ~out)
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(read(spark, folder, "pages"), RULES)


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, folder, "documents"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(read(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias("n_" + k)
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(pii.joined("base").cast("binary"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, folder, "documents")))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op7_token_matrices(spark: SparkSession, folder: str) -> DataFrame:
    return binary.matrices(read(spark, folder, "documents"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    out = held_out("doc_id", 4, 2)
    return language.language(docs, ~out).select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes)),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN p ON dw.n = p.n AND dw.p = p.p),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    members, _ = jaccard.similarity_join(read(spark, folder, "documents"))
    return members.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
r AS (SELECT doc_id, doc_id AS k FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.k = e.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(k) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.align(read(spark, folder, "documents"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS t(k))) GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
inside AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[i:i + 1], ' ') AS g FROM c, (VALUES (1), (2)) AS t(i) WHERE k = 3) GROUP BY lang, g),
parts AS (SELECT lang, g, k, a, j, array_to_string(w[1:j], ' ') AS lg, array_to_string(w[j + 1:], ' ') AS rg FROM c, (VALUES (1), (2)) AS t(j) WHERE j < k),
cuts AS (SELECT parts.*, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM parts JOIN f AS x ON x.lang = parts.lang AND x.g = lg AND x.k = j JOIN f AS y ON y.lang = parts.lang AND y.g = rg AND y.k = parts.k - j),
weak AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
kept AS (SELECT weak.* FROM weak LEFT JOIN inside ON weak.k = 2 AND inside.lang = weak.lang AND inside.g = weak.g WHERE coalesce(100 * longer < 50 * a, TRUE)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(read(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, hex(b[i:i + 99]) AS s FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, min(i) AS first, max(i) + 99 AS last FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later)) GROUP BY doc_id, g),
ends AS (SELECT doc_id, first, last FROM runs UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) FROM d),
kept AS (SELECT e.doc_id, string_agg(hex(b[coalesce(before, 0) + 1:first - 1]), '' ORDER BY first) AS k FROM (SELECT *, lag(last) OVER (PARTITION BY doc_id ORDER BY first) AS before FROM ends) AS e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id),
removed AS (SELECT doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN removed ON removed.doc_id = d.doc_id
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_fingerprints, op4_pii, op5_packing, op6_quality, op7_token_matrices, op8_language, op9_decontamination, op10_ngram_jaccard, op11_token_alignment, op12_collocations, op13_suffix_dedup)}
ORACLE = {"op9_decontamination": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op12_collocations": OP12_SQL, "op13_suffix_dedup": OP13_SQL}
