"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe_codec, centroid_clustering, decontaminate, html_extract, language_id, lexical_search, line_dedup, quality_model, quality_rules, secret_scan, simhash, token_store, warc
from pulsegrid.llm.common import held_out, shared_dir, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secret_scan.scan(documents, secret_scan.train(lexicon=secret_scan.corpus_lexicon(documents)), path="source")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("version")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors, network = quality_model.train(documents, table(spark, sf_dir, "labels"))
    out = quality_model.scored(documents, vectors, network)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(documents.where(~held_out()))
    return language_id.predicted(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), bpe_codec.default_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), folder, token_store.default_path())
    return token_store.read(spark, folder)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_decontaminate": op4_decontaminate,
        "op5_quality_model": op5_quality_model,
        "op6_language_id": op6_language_id,
        "op7_bpe_codec": op7_bpe_codec,
        "op8_simhash": op8_simhash,
        "op9_warc": op9_warc,
        "op10_html_extract": op10_html_extract,
        "op11_token_store": op11_token_store,
        "op12_lexical_search": op12_lexical_search,
        "op13_centroid_clustering": op13_centroid_clustering,
    }


def oracle_sql() -> dict[str, str]:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return {
        "op4_decontaminate": f"""
            WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {words} AS w FROM documents),
            b AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, {words} AS w FROM benchmark) AS i WHERE len(w) > 0),
            bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM b, unnest(generate_series(1, len(w) - m + 1)) AS t(i)),
            dw AS (SELECT rid, i, ms.m, array_to_string(w[i:i + ms.m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM bw) AS ms, unnest(generate_series(1, len(w) - ms.m + 1)) AS t(i) WHERE len(w) >= ms.m),
            h AS (SELECT rid, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
            hw AS (SELECT rid, count(DISTINCT k) AS n_hit FROM h, unnest(generate_series(i, i + m - 1)) AS t(k) GROUP BY rid),
            it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM h GROUP BY rid)
            SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
            FROM d LEFT JOIN hw ON d.rid = hw.rid LEFT JOIN it ON d.rid = it.rid
        """,
        "op9_warc": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
            SELECT p.page_id, p.payload_bytes, p.payload_digest,
                CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN first_id <> page_id THEN first_id END AS refers_to
            FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
        """,
        "op12_lexical_search": lexical_search.SQL,
        "op13_centroid_clustering": centroid_clustering.sql(),
    }
