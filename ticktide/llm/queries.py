"""The corpus queries, each a thin use of its operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktide.llm import common, language_model, licenses, mixing, near_dups, packing, pii, quality, tokenstore, topk, toxicity, vectorcodes, warc, whitening

TOKENIZER = "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(common.table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"
    rules, rate = F.array_join("failed_rules", ",").alias("failed_rules"), F.bround("host_rate", 6).alias("host_rate")
    return quality.judge(common.table(spark, sf_dir, "documents")).select(*columns, rules, rate)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(common.table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = common.table(spark, sf_dir, "documents"), common.fresh_path(spark, "token-store")
    return tokenstore.TokenStore.write(docs, public_tokenizers.path(TOKENIZER), folder).checksums().select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = common.table(spark, sf_dir, "labels").where("quality = 1")
    return language_model.classify(common.table(spark, sf_dir, "documents"), trusted)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(common.table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.fresh_path(spark, "warc")
    streams = warc.write(common.table(spark, sf_dir, "pages"), f"{folder}/streams")
    members = warc.normalise(streams, f"{folder}/streams", f"{folder}/members")
    return warc.read(members, f"{folder}/members").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_pii, op2_license_scan, op3_exact_top_k, op4_toxicity, op5_quality_rules, op6_minhash_near_dedup, op7_token_store, op8_mixing, op9_quality_classifier, op10_best_fit_packing, op11_vector_codes, op12_whitening, op13_warc)}
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

def _codebook_rounds(n: int) -> str:
    """Tables a<k>, each part's nearest entry of codebook c<k>, and the codebooks that follow."""
    nearest = "a{0} AS MATERIALIZED (SELECT vec_id, part, b.e AS entry, b.d AS d FROM (SELECT vec_id, p.part, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}}) AS b FROM p JOIN c{0} USING (part) GROUP BY 1, 2))"
    means = """m{1} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT part, entry, x, unnest(generate_series(1, len(x))) AS i FROM a{0} JOIN p USING (vec_id, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
      c{1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{0} LEFT JOIN m{1} USING (part, entry))"""
    return ", ".join([f"{nearest.format(k)}, {means.format(k, k + 1)}" for k in range(n)] + [nearest.format(n)])


ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s QUALIFY "rank" <= 5""",
    "op5_quality_rules": f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
      w AS (SELECT *, {_WORDS.format('t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
      p AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
      r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM p),
      k AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(5) AS g(j) WHERE c > 1 GROUP BY 1),
      m AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words FROM w LEFT JOIN k USING (doc_id)),
      f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, array_to_string(list_filter([CASE WHEN 10 * n_symbols > 3 * n_words THEN 'symbols' END, CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 'line_copies' END, CASE WHEN word_chars > 25 * n_words OR word_chars < 2 * n_words THEN 'word_length' END], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m),
      h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR failed_rules <> '') AS bad FROM f GROUP BY 1),
      a AS (SELECT greatest(least(avg(bad / n), 1 - 1e-6), 1e-6) AS mean, coalesce(var_samp(bad / n), 0) AS v, avg(1 / n) AS noise FROM h),
      b AS (SELECT mean, greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * noise, mean * (1 - mean) * 1e-4) - 1, 1.0) AS strength FROM a),
      q AS (SELECT source, (bad + mean * strength) / (n + strength) AS rate FROM h, b)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR failed_rules <> '' OR rate > 0.5) AS kept, rate > 0.5 AS host_rejected, failed_rules, round_even(rate, 6) AS host_rate FROM f JOIN q ON f.source IS NOT DISTINCT FROM q.source""",
    "op6_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, least(len(ws), 1)))) AS i FROM w)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
      reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
      c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
      SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op11_vector_codes": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      p AS MATERIALIZED (SELECT vec_id, j AS part, e[j * (len(e) // 4) + 1:(j + 1) * (len(e) // 4)] AS x FROM v, range(4) AS g(j)),
      c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256),
      {_codebook_rounds(4)},
      k AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY 1),
      h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN embeddings USING (vec_id), h""",
    "op13_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
      f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first FROM d)
      SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f""",
}
