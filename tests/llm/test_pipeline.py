"""The pipeline against a plain version of each stage over all documents of the smallest tables."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_duplicates import brute_budget_lines, brute_jaccard

import corpus_pipeline
from chronoloom.llm import decontamination, line_dedup, piece_sampling, quality

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scored = quality.op6_quality(spark, SMALL).collect()
    rows = {r.doc_id: rows[r.doc_id] for r in scored if r.kept}
    texts = sorted(rows.items())
    gone = {i: x for (i, _), x in zip(texts, brute_budget_lines(texts, line_dedup.CHARS_PER_EDIT, line_dedup.MAX_EDITS)) if x}
    left = {}
    for i, t in rows.items():
        lines = [x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, [])]
        if i not in gone or any(x.strip() for x in lines):
            left[i] = "\n".join(lines)
    left = {i: t for i, t in left.items() if (i, True) in {(d, d == c) for d, _, c in brute_jaccard(list(left.items()), 5, 80)}}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    matcher = decontamination.Matcher(bench, decontamination.EDIT_PERCENT)
    left = {i: t for i, t in left.items() if not matcher.find(decontamination.folded(t))}
    own = piece_sampling.sampler(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.pieces for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(left)
    assert all(own.decode(np.array(got[i], "int32")) == t for i, t in left.items())


def test_columns_of_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("pieces", F.lit(0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SMALL)
        assert out.columns == docs.columns and out.count() == 0, name
