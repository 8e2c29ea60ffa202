"""What steps leave on disk and shuffle: results stay the same with less of it."""

import time

import numpy as np
import pytest

from cladeweave.llm import exact_dedup, jaccard_join, shared


def shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n").count("shuffle_")


def test_a_written_table_leaves_no_shuffle(spark):
    setting = spark.conf.get(shared.CLEANUP)
    before = shuffle_files(spark)
    table = shared.cut(spark.range(1000).selectExpr("id", "id % 7 AS k").repartition("k"))
    end = time.time() + 20
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before and table.count() == 1000 and spark.conf.get(shared.CLEANUP) == setting


@pytest.mark.parametrize("hot", [16, 1 << 12])
def test_slices_meet_in_rounds_as_in_one(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", hot)
    rng = np.random.default_rng(5)
    rows = [(node, bytearray(np.append(rng.integers(0, 300, 4), 999 if node < 90 else 1000 + node).astype(np.int64).tobytes())) for node in range(150)]
    folder = spark.createDataFrame(rows, "node long, sigs binary").repartition(3)

    def regions(rounds):
        found: dict = {}
        for r in jaccard_join._members(folder, 4, rounds).collect():
            found.setdefault(r.region, set()).add(r.node)
        return found

    one = regions(1)
    assert regions(3) == one and max(map(len, one.values())) == 90 and len(one) > 20


def test_components_are_the_same_in_rounds(spark, monkeypatch):
    texts = [" ".join(f"w{v + k // 3 * 100}" for v in range(40 - k % 3)) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "ROUND_SHINGLES", 300)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {k: k // 3 * 3 for k in range(30)}


@pytest.mark.parametrize("large", [2, 3, 1 << 12])
@pytest.mark.parametrize("bits", [256, 2])
def test_texts_of_large_and_small_groups_are_compared(spark, monkeypatch, large, bits):
    monkeypatch.setattr(exact_dedup, "LARGE_GROUP", large)
    texts = [f"t{k % 11}" for k in range(60)] + ["one", "two", "two "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    rows = exact_dedup.exact_groups(docs, digest_bits=bits).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {k: (texts.index(t), texts.count(t)) for k, t in enumerate(texts)}


def test_texts_of_small_groups_are_shuffled_once(spark):
    asked = spark.createDataFrame([(bytearray(b"d"), bytearray(b"t"), False)], "digest binary, body binary, clash boolean")
    hits = spark.createDataFrame([(bytearray(b"d"), 1, 2)], "digest binary, keep_id long, n long")
    seen = exact_dedup._verified(asked, hits)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert [r.same for r in seen.collect()] == [True] and plan.count("LeftAnti") == 1


@pytest.mark.parametrize("keep", [exact_dedup.deduplicate, jaccard_join.keep_one])
@pytest.mark.parametrize("bits", [6, 12])
def test_crowded_bitmaps_drop_no_other_row(spark, monkeypatch, keep, bits):
    joined = []
    split = shared.split_by_ids

    def counted(docs, key, ids, _):
        free, maybe, name = split(docs, key, ids, bits)
        joined.append(maybe.count())
        return free, maybe, name

    monkeypatch.setattr(shared, "split_by_ids", counted)
    texts = [f"a{k} b{k} c{k} d{k} e{k} f{k}" for k in (j if j % 4 else j % 40 for j in range(200))]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x y z u v w"), (None, "x y z u v w"), (4, "an other text of id 4")], "doc_id long, text string")
    want = sorted([(k, t) for k, t in enumerate(texts) if texts.index(t) == k] + [(-1, "x y z u v w"), (4, "an other text of id 4")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in keep(docs).collect()) == want
    if bits == 12:  # the 40 copies that go are not joined with their texts
        assert joined[0] >= 40 and joined[1] < 15
