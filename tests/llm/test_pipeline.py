import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from brute import near_duplicate_classes
from ebbtide.llm.scratch import saved
from ebbtide.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(11)
    make = lambda n: [f"w{rng.choice('abcdefgh')}{rng.randrange(10**7)}x" for _ in range(n)]
    item, passage = make(40), make(60)
    texts = {k: make(80 + k) for k in range(30)}
    texts[3] += passage
    texts[7] = texts[7][:40] + passage + texts[7][40:]
    texts[8] += item[20:] + item[:20]
    texts[20] = list(texts[19])
    texts[20][50] = "changed"
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in texts.items()]
    rows += [(40, None, "en", "s", 0), (41, "12 ?!", "en", "s", 5), (42, "", None, None, 0), (43, rows[5][1], "en", "s", 1), rows[6], (None, " ".join(make(9)), "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        assert docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["language"]) == {*range(30), 43, None}
    assert set(kept["near_dedup"]) == {*range(30), None} - {20}
    assert len(kept["near_dedup"]) == corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(list(kept["language"].values()), SCHEMA), "").count()
    cut = kept["substring_dedup"]
    assert set(cut) == set(kept["near_dedup"]) and cut[7].text.split() == texts[7][:40] + texts[7][100:] and cut[7].n_chars == len(cut[7].text)
    assert all(cut[k] == kept["near_dedup"][k] for k in cut if k != 7)
    assert set(kept["decontamination"]) == set(cut) - {8}
    encoder = Tokenizer.from_file(tokenizer_path())
    crcs = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("piece").collect():
        crcs[r.doc_id].append(r.ids_crc32)
    for k, r in kept["decontamination"].items():
        ids = np.array(encoder.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        assert crcs[k] == [zlib.crc32(ids[s : s + 2048].tobytes()) for s in range(0, len(ids), 2048)]


def test_near_dedup_stage_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    classes = near_duplicate_classes({r.doc_id: r.text for r in docs.collect()})
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, c in classes.items() if k == c)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
