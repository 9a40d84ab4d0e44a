"""The pipeline's stages against their operators' brute force on the smallest tables."""
import os

import pytest

pytest.importorskip("tokenizers")
import corpus_pipeline as C  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "quality_rules":
            assert all(len(r["text"].encode().split()) >= 50 for r in rows)
        if name == "line_dedup":
            for i in set(before) - set(after):  # only documents all of whose lines are removed go
                assert len(before[i]["text"].split("\n")) >= 3
            seen = set()
            for i in sorted(after):  # each three-line window stands once in the whole table
                lines = [x.strip() for x in after[i]["text"].split("\n") if x.strip()]
                own = list(zip(lines, lines[1:], lines[2:]))
                old = [x.strip() for x in before[i]["text"].split("\n") if x.strip()]
                made = set(own) - set(zip(old, old[1:], old[2:]))  # windows that a removal has joined
                assert not (set(own) - made) & seen
                seen |= set(own)
        else:
            assert all(after[i] == before[i] for i in after)
        before = after


def test_run_returns_the_last_stage(spark):
    out = C.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert os.path.basename(C.__file__) == "corpus_pipeline.py"


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(docs.schema if k < 4 else None).parquet(f"{tmp_path}/{k}") if k < 4 else docs
    assert docs.count() == 0


def _windows(text):
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return set(zip(lines, lines[1:], lines[2:]))


def test_emptied_copies_and_repeated_rows_go(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    whole = next(r for r in rows if len(_windows(r["text"])) >= 3)
    none = {c: None for c in docs.columns}
    odd = [whole, whole, {**whole, "doc_id": 10**9}, {**none, "doc_id": 10**9 + 1}, {**none, "doc_id": 10**9 + 2, "text": " \n \n "}, none, none]
    df = spark.createDataFrame(odd, docs.schema)
    kept = C.line_dedup(spark, df.dropDuplicates(), SF).collect()
    assert {r["doc_id"] for r in kept} == {whole["doc_id"], 10**9 + 1, 10**9 + 2, None}
    left = C.near_dedup(spark, df, SF).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left) == [
        (False, whole["doc_id"]), (False, 10**9 + 1), (False, 10**9 + 2), (True, 0)]
    assert len({tuple(r) for r in left}) == len(left)


def test_run_on_odd_rows_leaves_only_its_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = {c: None for c in docs.columns}
    odd = spark.createDataFrame([{**none, "doc_id": 10**9}, none, none, {**none, "text": "x " * 200_000}], docs.schema)
    docs.unionAll(docs.limit(5)).unionAll(odd).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    out = C.run(spark, str(tmp_path))
    pieces = out.groupBy("doc_id", "start").count()
    assert out.count() > 0 and pieces.filter("count > 1").count() == 0
    new = [x for x in set(os.listdir(folder)) - before if "corpus-" in x]
    assert len(new) == 1 and "packing" in new[0]
