"""Each stage of the pipeline on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelex.llm import decontaminate, ngram_join, queries

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = queries.read(spark, FOLDER, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_join", "decontamination", "secrets", "packing"]
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
        if name == "ngram_join":
            assert ngram_join.report(docs).where("n_links > 0").count() == 0
        if name == "decontamination":
            bench = queries.read(spark, FOLDER, "benchmark")
            assert decontaminate.report(docs, bench).where("contaminated").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, FOLDER).count() == last.count()


#: Names that operators also make inside.
NAMES = ("hits", "id", "key", "row", "n", "x", "label", "score", "secrets", "spans", "class", "piece", "items", "kept")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_names_of_columns(spark, name):
    """Nulls, empty texts, repeated rows, further columns of any name, and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    shape = queries.read(spark, FOLDER, "documents")
    rows = [(None, None), (None, "some words"), (1, ""), (2, None), (3, "a few plain words"),
            (3, "a few plain words"), (4, "x" * 50_000), (5, "one two three " * 9_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in shape.schema if f.name not in ("doc_id", "text")}
    ).withColumns({c: F.lit(c) for c in NAMES})
    got = stage(spark, docs, FOLDER)
    assert stage(spark, docs.limit(0), FOLDER).collect() == []
    if name == "packing":
        assert {r["doc_id"] for r in got.select("doc_id").collect()} == {None, 1, 2, 3, 4, 5}
        return
    assert got.columns == docs.columns
    found = sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect()))
    wanted = sorted((d or 0, t or "") for d, t in rows)
    if name == "ngram_join":  # copies go, and texts without words are copies of each other
        assert len(found) == 5 and set(found) < set(wanted)
    else:
        assert found == wanted
    assert all(r[c] == c for r in got.select(*NAMES).collect() for c in NAMES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_send_small_batches_to_python(spark, name):
    stage, conf = dict(corpus_pipeline.STAGES)[name], "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = queries.read(spark, FOLDER, "documents").limit(5)
    before = spark.conf.get(conf)
    try:
        for value, wanted in ((10_000, 1_000), (0, 1_000), (64, 64)):
            spark.conf.set(conf, value)
            stage(spark, docs, FOLDER)
            assert int(spark.conf.get(conf)) == wanted
    finally:
        spark.conf.set(conf, before)


def test_rows_stay_out_of_the_search_for_windows(spark, monkeypatch):
    """Only keys and texts are searched: a row's further columns are not sent along with its text."""
    seen, search = [], decontaminate.contamination
    monkeypatch.setattr(decontaminate, "contamination", lambda docs, *a, **k: (
        seen.append(docs.columns), search(docs, *a, **k))[1])
    item = " ".join(f"b{n}" for n in range(12))
    docs = spark.createDataFrame([(1, "x " + item, "p"), (2, item.upper(), None), (3, None, "p"), (3, None, "p")],
                                 "doc_id long, text string, more string")
    kept = decontaminate.without_contaminated(
        docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(3, None, "p")] * 2 and seen == [["key", "text"]]
