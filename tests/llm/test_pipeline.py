"""The pipeline stage by stage against plain Python."""

from __future__ import annotations

import sentencepiece
from test_decontamination import brute as leaked
from test_near_dedup import brute as grouped
from test_rows import dedup_plain

import corpus_pipeline
from catalogspark.llm import line_dedup, quality_rules
from catalogspark.llm.queries import PIECES

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    scored = quality_rules.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = sorted((r.doc_id, r.text) for r in scored.where("kept").select("_row.doc_id", "_row.text").collect())
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = {
        "line_dedup": lambda rows: [(i, t) for (i, _), (t, _) in zip(rows, dedup_plain([t for _, t in rows]))],
        "near_dedup": lambda rows: [r for r in rows if {x[0]: x[3] for x in grouped(rows)}[r[0]]],
        "decontamination": lambda rows: [r for r in rows if r[0] not in {d for d, _ in leaked(rows, benchmark)}],
        "sentencepiece": lambda rows: rows,
    }
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        want = steps[name](want) if name in steps else want
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == want, name
        if name != "sentencepiece":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    final = sorted(docs.collect())
    assert final and all(r.token_ids == library.encode(r.text) and r.round_trip for r in final)
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == final


def test_odd_rows_pass_all_stages(spark, tmp_path):
    text = "alpha beta gamma delta " * 3 + " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, None), (1, text, "x"), (None, text, "x"), (2, None, "y"), (3, "", "z"), (4, text + " end", "z"), (5, "word " * 9000, "z")]
    docs = spark.createDataFrame([(i, t, "en", s, None, "mine", 7) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, w string, kept int")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, str(tmp_path))
            frame = spark.createDataFrame(frame.collect(), frame.schema)
            assert frame.columns[: len(docs.columns)] == docs.columns


def test_a_column_named_like_a_result_passes_the_stage(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd", 7), (2, "a\nb\nc\ne", None), (3, None, 1)], "doc_id long, text string, removed_lines int")
    kept = sorted(tuple(r) for r in corpus_pipeline.lines(spark, docs, SF).collect())
    assert kept == [(1, "a\nb\nc\nd", 7), (2, "e", None), (3, None, 1)]
    counted = line_dedup.dedup_lines(docs)
    assert counted.columns == ["doc_id", "text", "removed_lines"]
    assert sorted((r.doc_id, r.removed_lines) for r in counted.collect()) == [(1, 0), (2, 3), (3, 0)]
