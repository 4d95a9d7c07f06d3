"""The pipeline's stages on edge rows; test_near_copies compares its run with plain Python."""

import corpus_pipeline
from test_llm import EDGE, SCHEMA

SF = "/root/testdata/sf0.001"


def test_stages_take_edge_rows(spark):
    wide = spark.createDataFrame([(i, t, "en", None, None, "k", "t", "d", "f") for i, t in EDGE], SCHEMA)
    for rows in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == rows.columns and dict(out.dtypes) == dict(rows.dtypes)
            assert out.count() <= rows.count()
