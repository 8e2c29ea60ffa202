"""The pipeline's stages: columns, effect and survival of odd rows."""

import random

import corpus_pipeline

from cladeweave.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_effects(spark, tmp_path):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [say(rng.randrange(40, 90)) for _ in range(200)]
    labels = [(d, 1, int(d % 5 == 0)) for d in range(150)]
    texts = [t + " you stupid moron" if d % 5 == 0 else t for d, t in enumerate(texts)]
    leak = say(25)
    base = texts[1].split(" ")
    added = {300: texts[1] + "  ".strip(), 301: " ".join([*base, "tail"]), 302: say(20) + " " + leak, 303: None, 304: "", 305: say(30)}
    rows = [(d, t, "en", "s", 0) for d, t in [*enumerate(texts), *added.items()]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {d for d in range(200) if d % 5 == 0} | {300, 301, 302, 304}
    assert set(got) == (set(range(200)) | set(added)) - gone
    assert got[303].token_ids == [2] and got[305].token_ids[-1] == 2
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_stages_with_empty_tables_repeated_rows_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    rows = [(1, "one text here", "en", "s", 0), (1, "one text here", "en", "s", 0), (None, None, None, None, None), (2, "a b c d e f g h", "en", "s", 0), (3, "a b c d e f g h", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "7 AS drop_id", "8 AS drop_word", "9 AS text_key", "10 AS is_kept", "11 AS node", "12 AS id")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.drop_id, r.text_key) for r in docs.collect()) == [(0, 7, 9), (1, 7, 9), (2, 7, 9)]


def test_last_stage_decodes_its_ids(spark):
    docs = spark.createDataFrame([(1, "a text to read back", "en", "s", 0), (2, None, "en", "s", 0)], DOCS)
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    assert (got[1].decoded, got[2].decoded) == ("a text to read back", "")
    assert got[2].token_ids == [2]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
