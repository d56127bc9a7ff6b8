"""The pipeline's stages against brute force over the small tables."""

import re

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_llm import ODD, SF_DIR, UNLEARNED, brute_components, brute_hits, frame, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and the last result, as the checker makes them."""
    out = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[r.asDict() for r in df.collect()] for df in out]


def test_stages_return_documents(stages):
    for rows in stages[:-1]:
        assert rows and list(rows[0]) == COLUMNS


def test_language_keeps_documents_with_a_language(stages):
    assert {r["doc_id"] for r in stages[1]} >= {r["doc_id"] for r in stages[0] if re.search(r"[^\W\d_]", r["text"] or "") and len(r["text"]) > 200}


def test_one_document_of_each_group_stays(stages):
    groups = brute_components([(r["doc_id"], r["text"]) for r in stages[1]], 5)
    assert {r["doc_id"] for r in stages[2]} == {i for i, _, _, kept in groups if kept}


def test_no_benchmark_passage_is_left(stages):
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    hit = {i for i, _, n, _, _ in brute_hits([(r["doc_id"], r["text"]) for r in stages[2]], items) if n}
    after = {r["doc_id"]: r for r in stages[3]}
    assert hit and all(n == 0 for _, _, n, _, _ in brute_hits([(i, r["text"]) for i, r in after.items()], items))
    assert all(after[r["doc_id"]] == r for r in stages[2] if r["doc_id"] not in hit)
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_secrets_are_masked(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3]}
    assert set(before) == {r["doc_id"] for r in stages[4]}
    for r in stages[4]:
        assert not re.search("[0-9a-f]{24,}", r["text"] or "")
        assert r["text"] == before[r["doc_id"]] or "[SECRET]" in r["text"]


def test_packing_covers_what_is_left(stages):
    starts = [r["doc_id"] for r in stages[5] if r["start"] == 0]
    assert sorted(starts) == sorted(r["doc_id"] for r in stages[4])
    assert all(r["length"] + r["offset"] <= 2048 for r in stages[5])


def test_run_is_the_stages_in_order(spark, stages):
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(stages[5])


CLASHES = ("__key", "__doc", "__row", "__same", "__places", "__new", "__found", "__base", "found", "w", "node", "class", "lang_pred_", "ids", "start")


def test_stages_take_odd_rows_and_extra_columns(spark):
    """Nulls, empty and long texts, ties, repeated rows and names that the operators use."""
    real = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(None if i is None else 10_000 + i, t) for i, t in ODD] + [(20_000, real.where("length(text) > 500 and lang = 'en'").first().text)] * 3
    rows += [(30_000 + i, t) for i, t in enumerate(UNLEARNED.values())]
    docs = real.unionByName(frame(spark, rows).withColumn("lang", F.lit(None).cast("string")))
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(f"clash {name}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF_DIR), "odd")
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        assert all(docs.where(F.col(c) != f"clash {c}").isEmpty() for c in CLASHES)
        if name == "language ID":
            ids = [r.doc_id for r in docs.collect()]
            assert not {10_001, 10_002, 10_003, 10_005} & set(ids) and not any((i or 0) >= 30_000 for i in ids)
            assert ids.count(20_000) == 3
        else:
            assert docs.where("doc_id = 20000").count() <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= docs.count()


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), SF_DIR).count() == 0


def test_stages_keep_null_and_empty_texts(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, " "), (None, None)])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert sorted((r.doc_id or 0, r.text or "") for r in stage(spark, docs, SF_DIR).collect()) == [(0, ""), (1, ""), (2, ""), (3, " ")]
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR).count() == 4
