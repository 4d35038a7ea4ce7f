"""The pipeline's stages against brute force, each on the rows that its predecessor kept."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from molquarry.llm import decontaminate
from molquarry.llm.queries import tokenizer_path
from molquarry.llm.tokens import WordIds

from .test_operators import brute_components, brute_items, brute_secrets, sets_of


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", None), (10_002, "12 34", "en", "s", 5)], docs.schema)
    rows = whole.unionByName(extra)
    outs = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, sf_dir).write.parquet(str(tmp_path / str(i)))
        rows = spark.read.parquet(str(tmp_path / str(i)))
        outs.append((name, rows))
        if i < 4:
            assert rows.columns == whole.columns
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    kept = [read(o) for _, o in outs[:4]]
    assert set(kept[0]) == {d for d, t in read(whole).items() if any(map(str.isalpha, t))}
    groups = brute_components(sets_of(kept[0].items(), 5), 80, 100)
    assert kept[1] == {d: t for d, t in kept[0].items() if groups[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_items(items, kept[1].items(), 10)
    assert set(kept[2]) == {d for d, (n, h, _) in hits.items() if h <= 0.5 * n}
    for d, t in kept[2].items():
        assert len(decontaminate.words_of(t)) == hits[d][0] - hits[d][1] or hits[d][1] > 0
        assert hits[d][1] or t == kept[1][d]
    assert set(kept[3]) == set(kept[2])
    for d, t in kept[3].items():
        assert not brute_secrets(t) and re.sub(r"\[SECRET\]", "", t) != "" and (t == kept[2][d]) == (not brute_secrets(kept[2][d]))
    enc = WordIds(tokenizer_path())
    place = outs[4][1].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in place} == {d: len(np.frombuffer(enc.packed(t), "<u4")) + 1 for d, t in kept[3].items()}
