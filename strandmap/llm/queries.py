"""Driver queries of the training-data operators, one thin query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmap.llm import hnsw, html, media, mixing, packing, quality, sharding, simhash, tokens, urlfilter
from strandmap.llm.shared import cut, word_count


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: Host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT p.page_id, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS rn
  FROM parts p JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.rn = 1
"""


def op3_sharding(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(docs.withColumn("text_crc32", F.coalesce(F.crc32("text"), F.lit(0)).cast("long")), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: Scores from here on are label 1.
QUALITY_CUT = 0.3


def op4_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.training_rows(_table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted")
    )


def op5_packing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("n_words"))
    packed = packing.pack(cut(docs), "n_words", budget=8192, buckets=16)  # the texts are read once
    return packed.select("doc_id", F.col("length").alias("n_words"), "bucket", "padded", "batch", "place")


def op6_token_files(spark, sf_dir):
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.digest(tokens.write(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op7_media_columns(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.read_back(media.with_media(docs)).drop("keyframes")  # the feature names them all


def op8_embedding_dedup(spark, sf_dir):
    found = hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)
    kept = F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op9_source_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_words"))
    mixed = mixing.mix(cut(docs), F.col("n_words"), weights=(3, 1, 2), share=1.5, most=2.0)  # the texts are read once
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_html_extraction(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries():
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_url_filter": op2_url_filter,
        "op3_sharding": op3_sharding,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_packing": op5_packing,
        "op6_token_files": op6_token_files,
        "op7_media_columns": op7_media_columns,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_source_mixing": op9_source_mixing,
        "op10_html_extraction": op10_html_extraction,
    }


def oracle_sql():
    return {"op2_url_filter": OP2_SQL}
