"""One query an operator, over its whole table, and DuckDB SQL where that can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_dedup, cotraining, exact_dedup, filter_audit, kdtree, media, minhash, mixing, name_join, ngram_lm, packing, simhash, token_codec
from .tokens import public_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.encode_and_read(_docs(spark, sf_dir), public_path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_components(_docs(spark, sf_dir), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))[0].select("doc_id", "source", "size", "source_size", "target", "taken", "shards", "first_shard")


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.train_and_score(_docs(spark, sf_dir), order=3).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.stored_text_features(_docs(spark, sf_dir))
    feature = F.concat_ws(":", F.concat(F.col("width"), F.lit("x"), F.col("height")), "thumbnail_hash", "average_hash")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kdtree.document_shards(_docs(spark, sf_dir), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.repeats_digest(_docs(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "quality", "toxic", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), public_path("byte_bpe_50k.json"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_docs(spark, sf_dir))


def op12_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors, clients = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("vendors", "clients"))
    return name_join.joined_names(vendors.select("vendor_id", name_join.misspelt(F.col("vendor_id"), F.col("name")).alias("name")), clients)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.corpus_audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_token_store, op3_near_dedup, op4_mixing, op5_ngram_lm, op6_media, op7_kd_shards, op8_bwt_dedup, op9_quality, op10_packing, op11_simhash, op12_name_join, op13_filter_audit)}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(length(text), 0) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), r AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""",
    "op12_name_join": r"""
        WITH ids AS (SELECT DISTINCT vendor_id::VARCHAR AS id FROM vendors UNION SELECT DISTINCT client_id::VARCHAR FROM clients),
        crcs AS (
            SELECT id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda c: ascii(c)::BIGINT)),
                lambda a, b: xor(list_reduce(list_prepend(xor(a, b) & 255, range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END), a >> 8)), 4294967295) AS crc
            FROM ids
        ), stored AS (
            SELECT vendor_id, name, crc % (length(name) - 1) AS pos, crc % 2 = 0 AND length(name) >= 2 AS wrong FROM vendors JOIN crcs ON id = vendor_id::VARCHAR
        ), written AS (
            SELECT vendor_id, CASE WHEN wrong THEN substr(name, 1, pos) || substr(name, pos + 2, 1) || substr(name, pos + 1, 1) || substr(name, pos + 3) ELSE name END AS name FROM stored
        ), v AS (
            SELECT DISTINCT vendor_id, translate(regexp_replace(name, '[\x20\x09-\x0D]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS form FROM written
        ), c AS (
            SELECT client_id, crc, translate(regexp_replace(name, '[\x20\x09-\x0D]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS form
            FROM clients LEFT JOIN crcs ON id = client_id::VARCHAR
        ), names AS (SELECT form, false AS client FROM v UNION SELECT form, true FROM c),
        variants AS (
            SELECT form, client, unnest(list_distinct(list_prepend(form, list_transform(range(1, length(form) + 1), lambda i: substr(form, 1, i - 1) || substr(form, i + 1))))) AS variant
            FROM names WHERE form <> ''
        ), met AS (
            SELECT DISTINCT a.form AS one, b.form AS two, list_filter(range(1, length(a.form) + 1), lambda i: substr(a.form, i, 1) <> substr(b.form, i, 1)) AS odd
            FROM variants a JOIN variants b USING (variant) WHERE NOT a.client AND b.client
        ), near AS (
            SELECT one, two, CASE WHEN one = two THEN 0 ELSE 1 END AS distance FROM met
            WHERE length(one) <> length(two) OR len(odd) <= 1
               OR len(odd) = 2 AND odd[2] = odd[1] + 1 AND substr(one, odd[1], 1) = substr(two, odd[2], 1) AND substr(one, odd[2], 1) = substr(two, odd[1], 1)
        )
        SELECT vendor_id, distance, count(*) AS n_clients, min(client_id) AS first_client_id, coalesce(sum(crc), 0)::BIGINT AS clients_crc
        FROM v JOIN near ON v.form = one JOIN c ON c.form = two GROUP BY vendor_id, distance""",
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        f AS (
            SELECT doc_id, part,
                (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * (regexp_matches(text, '[#$%&*|]'))::INT
                + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), count(doc_id) OVER (PARTITION BY text) > 0)::INT AS mask
            FROM t
        ), l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        k AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
        o AS (
            SELECT [a.k, b.k, c.k, d.k, e.k] AS ks, substr('ABCDE', a.k + 1, 1) || substr('ABCDE', b.k + 1, 1) || substr('ABCDE', c.k + 1, 1) || substr('ABCDE', d.k + 1, 1) || substr('ABCDE', e.k + 1, 1) AS filter_order
            FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
        ), s AS (
            SELECT filter_order, step, 1 << ks[step] AS own, list_sum(list_transform(ks[1:step - 1], lambda x: 1 << x))::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)
        ), s0 AS (SELECT filter_order, step, own, coalesce(before, 0) AS before FROM s),
        r AS (
            SELECT part, filter_order, step, own,
                sum(n) FILTER (mask & (before | own) = 0) AS kept, sum(n) FILTER (mask & own > 0 AND mask & before = 0) AS removed,
                sum(n) FILTER (mask & own > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
                sum(good) FILTER (mask & own > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & own > 0 AND mask & before = 0) AS toxic_lost
            FROM m, s0 GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
            coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
            coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
        FROM r""",
}
