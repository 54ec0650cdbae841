"""The registered queries of the text operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from . import binary_ids, decontam, exact_dedup, html_extract, langid, minhash, packing, phrases, pii, resample, simhash, token_count, warc

Q, O = {}, {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def documents(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "documents").select("doc_id", "text")


@query
def op1_personal_data(spark: SparkSession, path: str) -> DataFrame:
    found = pii.personal_data(documents(spark, path))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query
def op2_token_counts(spark: SparkSession, path: str) -> DataFrame:
    return token_count.token_counts(documents(spark, path))


@query
def op3_benchmark_decontamination(spark: SparkSession, path: str) -> DataFrame:
    found = decontam.contamination(documents(spark, path), table(spark, path, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def _words(name: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT {name}, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"


O["op3_benchmark_decontamination"] = f"""
WITH d AS ({_words('doc_id')} FROM documents),
b AS ({_words('item_id')} FROM benchmark),
items AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b) WHERE n > 0)),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
met AS (SELECT DISTINCT doc_id, n, i, item_id FROM grams JOIN items USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op4_warc_round_trip(spark: SparkSession, path: str) -> DataFrame:
    files = materialize(warc.write_warc(warc.with_revisits(table(spark, path, "pages")), scratch_path(spark, "warc")))
    return warc.read_warc(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


O["op4_warc_round_trip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""


@query
def op5_simhash_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    return simhash.near_components(documents(spark, path)).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op6_html_main_text(spark: SparkSession, path: str) -> DataFrame:
    pages = table(spark, path, "pages")
    return html_extract.main_text(pages, html_extract.fit(pages))


@query
def op7_token_ids_orc(spark: SparkSession, path: str) -> DataFrame:
    folder = scratch_path(spark, "ids")
    binary_ids.write_ids(documents(spark, path), folder)
    return binary_ids.id_checksums(binary_ids.read_ids(spark, folder))


@query
def op8_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    return exact_dedup.dedup_report(documents(spark, path))


O["op8_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query
def op9_best_fit_packing(spark: SparkSession, path: str) -> DataFrame:
    return packing.pack_documents(documents(spark, path))


@query
def op10_language_id(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    samples = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, samples).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op11_importance_resampling(spark: SparkSession, path: str) -> DataFrame:
    return resample.resample(documents(spark, path), table(spark, path, "benchmark"))


# crc32 by its bits: one byte at a time against a table that the polynomial gives.
O["op11_importance_resampling"] = f"""
WITH d AS ({_words('doc_id')} FROM documents),
b AS ({_words('item_id')} FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
poly AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i,
  list_reduce(list_prepend(i, range(8)), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM range(256) g(i))),
bytes AS (SELECT word, list_transform(range(1, strlen(word) + 1), lambda k: CAST(('0x' || substr(hex(encode(word)), CAST(2 * k - 1 AS INT), 2)) AS BIGINT)) AS u
  FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
sums AS (SELECT word, xor(list_reduce(list_prepend(4294967295, u), lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM bytes, poly),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN sums USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN sums USING (word) GROUP BY bucket),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
  / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM dw JOIN sums USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
best AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN best USING (doc_id)
"""


@query
def op12_minhash_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    return minhash.keep_one(documents(spark, path))


O["op12_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
f AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.h = y.h AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a, b HAVING 100 * count(*) >= 85 * (max(x.n) + max(y.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, root) AS component_id, doc_id = least(doc_id, root) AS kept
FROM s JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) ON doc_id = node
"""


@query
def op13_phrase_collocations(spark: SparkSession, path: str) -> DataFrame:
    return phrases.collocations(table(spark, path, "documents").select("lang", "text"))


O["op13_phrase_collocations"] = r"""
WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-]')) AS p FROM (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) g(k) WHERE len(w) >= k)) GROUP BY ALL),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS v FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT lang, phrase, a, k, array_to_string(v[:k], ' ') AS first, array_to_string(v[k + 1:], ' ') AS rest FROM c, range(1, 3) g(k) WHERE k < len(v)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, cut.k, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * cut.a * cut.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored),
inner_ AS (SELECT lang, array_to_string(v[i:i + 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 3) g(i) WHERE len(v) = 3 GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN inner_ USING (lang, phrase) WHERE o = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM placed JOIN n USING (lang) WHERE rank <= 2000
"""
