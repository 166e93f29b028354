"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_tm_lines").cast("long").alias("n_lines"), F.col("_tm_kept").cast("long").alias("n_kept"), "text")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import pii

    found = pii.find_personal_data(table(spark, sf_dir, "documents"), pii.train(pii.labelled_table(spark)))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import language

    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.topk import largest

    return largest(table(spark, sf_dir, "embeddings"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html import extract

    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pieces import encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op3_personal_data": op3_personal_data,
    "op4_language": op4_language,
    "op5_ann": op5_ann,
    "op6_topk": op6_topk,
    "op7_html": op7_html,
    "op8_simhash": op8_simhash,
    "op9_pieces": op9_pieces,
    "op10_mixing": op10_mixing,
}

def _base32_sql(hexed: str) -> str:
    """RFC 4648 base32 of 40 hex digits in DuckDB."""
    letters = []
    for k in range(8):
        value = f"CAST('0x' || substr({hexed}, {5 * k + 1}, 5) AS BIGINT)"
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({value} >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(letters)


#: DuckDB SQL where SQL can express the operator and is fast enough on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hexed FROM p), k AS (SELECT hexed, max(page_id) AS keeper FROM d GROUP BY hexed)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_base32_sql("hexed")} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d JOIN k USING (hexed)""",
    "op6_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 5""",
}
