"""The pipeline end to end against what each stage should leave of a small corpus."""

import numpy as np
import public_tokenizers
from test_operators import prose
from tokenizers import Tokenizer

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    good = [prose(120, 300 + i, 3000) for i in range(120)]
    junk = ["Der " * 120 if i % 2 else prose(120, 900 + i).upper() + "!! ###" for i in range(40)]
    items = [prose(30, 5000 + i, 3000) for i in range(3)]
    copies = [good[5], good[6] + " more"]
    leaks = [prose(80, 7000, 3000) + " " + items[1] + " " + prose(80, 7001, 3000)]
    personal = [prose(90, 7100, 3000) + " jane@example.org " + prose(30, 7101, 3000)]
    texts = [*good, *junk, *copies, *leaks, *personal]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 120), 0) for i in range(160) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    pieces = corpus_pipeline.run(spark, str(tmp_path)).orderBy("sequence_id", "offset").collect()
    ids = {}
    for p in pieces:
        ids[p.doc_id] = ids.get(p.doc_id, []) + np.frombuffer(p.ids, "<u4").tolist()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {i: tokenizer.decode(x[:-1]) for i, x in ids.items()}
    want = {i: t for i, t in enumerate(good)} | {len(texts) - 1: personal[0].replace("jane@example.org", "<EMAIL>")}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(want[i] == t for i, t in got.items()) and all(x[-1] == 0 for x in ids.values())
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_near_copies_of_null_and_repeated_ids(spark):
    a, b, c = (prose(60, i, 3000) for i in range(3))
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (3, b), (4, c), (None, c)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.keep_first_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(tuple(r)[:2] for r in got.collect()) == [(1, a), (3, b), (4, c)]
