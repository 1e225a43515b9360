"""One query for each operator over its whole table, and the same result in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import collocations, exact_dedup, fill_in_middle, jaccard_join, language_id, mixing, packing, pii, substring_dedup, suffix_dedup, token_files, topk, toxicity
from tidemark.llm.common import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_earlier(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'token_files').path}/set"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    plan = mixing.mix_plan(docs, size="size")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = [F.lit(k) for k in pii.BASE]
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE],
        F.sha2(joined(F.filter("found", lambda x: x["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    output, form = F.col("fim_output"), F.col("fim_form")
    return cut.select(
        "doc_id", F.col("fim_n").alias("n"), form.alias("form"),
        F.char_length("fim_prefix").cast("long").alias("prefix_chars"), F.char_length("fim_middle").cast("long").alias("middle_chars"),
        digest(output).alias("output_sha256"), digest(fill_in_middle.restore(output, form)).alias("restored_sha256"),
    )


SQL_OP1 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), w AS (
  SELECT h, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY h
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN w USING (h)
"""

SQL_OP2 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), h AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h, unnest(range(1, len(w) - 33)) AS i
  FROM w WHERE len(w) >= 35
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1)
), t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w), k AS (
  SELECT doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE c.j IS NULL) AS kept FROM t LEFT JOIN c USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

SQL_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL_OP4 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), h AS (
  SELECT doc_id, unnest(list_transform(range(1, n - 98), lambda i: md5(substr(x, 2 * i - 1, 200)))) AS h, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100
), l AS (
  SELECT doc_id, i FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), g AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l), r AS (
  SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g
), s AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM r GROUP BY doc_id, run), q AS (
  SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s
), k AS (
  SELECT doc_id, CAST(sum(b - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS head
  FROM q JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

SQL_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.8
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a), l AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, coalesce(least(doc_id, c.b), doc_id) AS class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN c ON c.a = doc_id LEFT JOIN l ON l.a = doc_id
"""

SQL_OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 2.0::DOUBLE * n AS cap, 1.5::DOUBLE * sum(n) OVER () AS total,
    coalesce(sum(2.0::DOUBLE * n) OVER o, 0) AS full_cap, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max((total - full_cap) / open_w) FILTER (WHERE (total - full_cap) / open_w * w <= cap) AS level FROM f
), t AS (
  SELECT source, n, least(cap, coalesce(level, 'inf'::DOUBLE) * w) AS target FROM f, l
), r AS (
  SELECT *, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate FROM t
), k AS (SELECT unnest(range(16)) AS seed), u AS (
  SELECT d.doc_id, d.size, r.source, r.n, r.target, floor(r.rate) AS base, r.rate - floor(r.rate) AS frac, k.seed,
    ('0x' || substr(md5((k.seed // 4)::VARCHAR || '|' || coalesce(d.doc_id::VARCHAR, '')), 1 + 8 * (k.seed % 4)::INT, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, k
), e AS (
  SELECT source, seed, abs(sum(CASE WHEN draw < frac THEN size ELSE 0 END) - any_value(frac) * any_value(n)) AS off FROM u GROUP BY source, seed
), b AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM e GROUP BY source)
SELECT u.doc_id, u.size, u.n AS source_size, u.target, CAST(u.size * (u.base + CASE WHEN u.draw < u.frac THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.seed = b.seed
"""

SQL_OP12 = r"""
WITH p AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), g AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k)
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10), cut AS (
  SELECT *, unnest(range(1, k)) AS c FROM cand
), part AS (
  SELECT cut.*, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * cut.a * cut.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[:cut.c], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[cut.c + 1:], ' ')
), s AS (SELECT lang, phrase, k, a, arg_min({'l': l, 'r': r, 'score': score}, (score, part.c)) AS b FROM part GROUP BY ALL), inside AS (
  SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase, a FROM cand WHERE k = 3
), most AS (SELECT lang, phrase, max(a) AS around FROM inside GROUP BY ALL), t AS (
  SELECT lang, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM s JOIN n USING (lang) LEFT JOIN most USING (lang, phrase)
  WHERE around IS NULL OR 100 * around < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM t QUALIFY rank <= 2000
"""

SQL_OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), x AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), y AS (
  SELECT *, array_to_string(u[:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM x
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM y
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_topk_search": op3_topk_search,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_files": op6_token_files,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_source_mixing": op8_source_mixing,
    "op9_language_id": op9_language_id,
    "op10_pii": op10_pii,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_exact_dedup": SQL_OP1,
    "op2_substring_dedup": SQL_OP2,
    "op3_topk_search": SQL_OP3,
    "op4_suffix_array_dedup": SQL_OP4,
    "op7_ngram_jaccard_join": SQL_OP7,
    "op8_source_mixing": SQL_OP8,
    "op12_collocations": SQL_OP12,
    "op13_fill_in_middle": SQL_OP13,
}
