"""Training order reaches the pipeline's last stage."""

from collections import Counter

import corpus_pipeline


def test_tokens_keep_the_training_position(spark, tmp_path):
    rows = [(n, "word " * (5 + n % 7) + str(n), f"s{n % 3}") for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    found = corpus_pipeline.tokenize(spark, mixed, "").select("doc_id", "position").collect()
    wanted = mixed.select("doc_id", "position").collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, wanted))
    assert len({r.position for r in found}) > 30
