import pyarrow as pa

import corpus_pipeline
from ebbtide.llm import scratch
from ebbtide.llm.decontaminate import contaminated
from ebbtide.llm.packing import pack_documents
from ebbtide.llm.scratch import BATCH_BYTES, saved_in_batches

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_rows_are_small_and_the_limit_is_put_back(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "n"])

    before = spark.conf.get(LIMIT)
    rows = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 4000) text")
    found = saved_in_batches(rows.mapInArrow(sizes, "bytes long, n long"), "sizes").collect()
    assert sum(r.n for r in found) == 6000 and max(r.bytes for r in found) < 2 * BATCH_BYTES
    assert spark.conf.get(LIMIT) == before


def test_steps_that_read_whole_texts_ask_for_small_batches(spark, monkeypatch):
    limits = {}

    def recorded(df, name, write=scratch.saved):
        limits[name] = int(df.sparkSession.conf.get(LIMIT).rstrip("b"))
        return write(df, name)

    monkeypatch.setattr(scratch, "saved", recorded)
    monkeypatch.setattr(corpus_pipeline, "saved", recorded)
    before = spark.conf.get(LIMIT)
    docs = spark.createDataFrame([(1, "one two three four five six", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()] == [1]
    assert pack_documents(docs).count() == 2
    assert [r.doc_id for r in contaminated(docs, docs.selectExpr("doc_id as item_id", "text")).collect()] == [1]
    assert {name: limits.get(name) for name in ("rejected", "pieces", "found")} == dict.fromkeys(("rejected", "pieces", "found"), BATCH_BYTES)
    assert spark.conf.get(LIMIT) == before
