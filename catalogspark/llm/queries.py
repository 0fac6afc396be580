"""One query per corpus operator, over its whole table with production parameters, and the SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm import (
    alignment,
    cotraining,
    decontamination,
    language_model,
    line_dedup,
    main_text,
    near_dedup,
    page_layouts,
    pieces,
    quality_rules,
    resampling,
    sharding,
    suffix_dedup,
    warc,
)
from catalogspark.llm.common import table
from catalogspark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The public vocabularies that texts are encoded with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PAIRS = "/opt/tokenizers/byte_bpe_50k.json"


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query()
def op1_cotraining(spark, sf_dir):
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


@query()
def op3_simhash_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_sentencepiece(spark, sf_dir):
    return pieces.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES).drop("text")


@query(
    """WITH lined AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each_line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM lined),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM each_line
  WHERE trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
threes AS (SELECT doc_id, k, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM full_lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
later AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, k) AS nth
  FROM threes WHERE c IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, k + d AS k FROM later, (SELECT unnest([0, 1, 2]) AS d)),
kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) FILTER (g.k IS NULL) AS text, count(g.k) AS n
  FROM each_line e LEFT JOIN full_lines f USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.k = f.k GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, kept.n::INT AS removed_lines
FROM documents d JOIN kept USING (doc_id)"""
)
def op5_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op6_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query()
def op8_quality_rules(spark, sf_dir):
    scored = quality_rules.score_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    return scored.select(F.col("_row.doc_id").alias("doc_id"), *counts)


@query()
def op9_pitman_yor_scores(spark, sf_dir):
    return language_model.score_texts(table(spark, sf_dir, "documents"))


@query(
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f"""
)
def op10_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query()
def op11_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return main_text.extract(pages, page_layouts.labelled_pages(pages))


@query()
def op12_cross_tokenizer_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_PAIRS, PIECES)


@query()
def op13_importance_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
