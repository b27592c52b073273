"""What a Python worker still holds after a stage."""

import pyarrow as pa

import corpus_pipeline


def test_segmentation_leaves_nothing_in_idle_workers(spark):
    docs = spark.createDataFrame([(i, f"one word after another {i} " * 20) for i in range(40)], "doc_id long, text string").repartition(4)

    def held(batches):
        from signalframe.llm import segment

        yield from (pa.RecordBatch.from_arrays([pa.array([segment.walks.cache_info().currsize + segment.vocabulary.cache_info().currsize])], ["n"]) for _ in batches)

    assert all(r["lossless"] for r in corpus_pipeline.segment_pieces(spark, docs, "").collect())
    assert {r["n"] for r in docs.mapInArrow(held, "n long").collect()} == {0}
