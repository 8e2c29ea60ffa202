"""The web archive, the Merkle manifest and hard negatives against plain versions."""

import base64
import hashlib
import itertools
import math
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cladeweave.llm import hard_negatives, merkle, warc

PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


# Web archive


def pages_of(rng):
    bodies = ["", None, "a", "<p>ü\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n</p>", "x" * 70_000, " ", "tail\r\n\r\n"]
    rows = [(k, f"http://h{k % 3}/ {k}\r\nX: y", rng.choice(bodies)) for k in range(60)]
    rows += [(100, None, "b"), (100, "u", "b"), (100, "u", "a"), (None, "u", "b"), (None, None, "c"), (None, None, "c"), (7, "u", None), (-5, "u", "a")]
    rng.shuffle(rows)
    return rows


def test_archive_against_plain_records(spark, tmp_path):
    rows, to = pages_of(random.Random(1)), folder(tmp_path)
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "html AS payload", "1 AS sha256", "2 AS records").repartition(5)
    warc.write_archive(df, to)
    got = warc.read_archive(spark, to).collect()
    assert len(got) == len(rows)
    first = {}
    for page, _, html in rows:
        body = html or ""
        first[body] = min(first.get(body, math.inf), page if page is not None else math.inf)
    for r in got:
        body = r.payload.decode()
        assert r.payload_bytes == len(r.payload) and r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        refers = first[body] if first[body] < math.inf else None
        assert r.refers_to == (refers if r.record_type == "revisit" else None)
        assert r.record_type == "revisit" or r.page_id == refers
    assert sorted(((r.page_id, r.payload.decode()) for r in got), key=str) == sorted(((p, h or "") for p, _, h in rows), key=str)
    responses = [r.payload for r in got if r.record_type == "response"]
    assert len(responses) == len(set(responses)) == len(first)
    # Each payload is stored once, by its digest.
    stored = spark.read.parquet(f"{to}/payloads").collect()
    assert sorted(r.sha256 for r in stored) == sorted(hashlib.sha256(b.encode()).hexdigest() for b in first)
    query = warc.archive_and_read(spark, df)
    assert query.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and query.count() == len(rows)


def test_small_payloads_are_all_responses(spark, tmp_path):
    to = folder(tmp_path)
    warc.write_archive(spark.createDataFrame([(k, "u", "abc" if k % 2 else "abcd") for k in range(6)], PAGES), to, least_bytes=4)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_archive(spark, to, with_payload=False).collect()}
    assert got == {(1, "response", None), (3, "response", None), (5, "response", None), (0, "response", None), (2, "revisit", 0), (4, "revisit", 0)}
    assert spark.read.parquet(f"{to}/payloads").count() == 2


def test_shared_payloads_are_dealt_over_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_RECORDS", 4)
    rows, to = [(k, "u", "hot" if k % 3 else f"own {k}") for k in range(60)], folder(tmp_path)
    warc.write_archive(spark.createDataFrame(rows, PAGES), to)
    assert [(r.shards) for r in spark.read.parquet(f"{to}/spread").collect()] == [10]
    assert spark.read.parquet(f"{to}/headers").where("shard > 0").count() > 20
    got = warc.read_archive(spark, to).collect()
    assert sorted((r.page_id, r.payload.decode()) for r in got) == sorted((p, h) for p, _, h in rows)


def test_exported_files_are_records_of_the_format(spark, tmp_path):
    rows, to = pages_of(random.Random(2)), folder(tmp_path)
    warc.write_archive(spark.createDataFrame(rows, PAGES), to)
    warc.export_warc(spark, to, f"{to}/files", records_per_file=9)
    found = warc.read_warc(spark, f"{to}/files/part-*").collect()
    assert len(found) == len(rows) and len({r.fields["WARC-Record-ID"] for r in found}) == len(rows)
    by_id = {r.fields["WARC-Record-ID"]: r for r in found}
    for r in found:
        head, _, body = bytes(r.block).partition(b"\r\n\r\n")
        origin = by_id[r.fields["WARC-Refers-To"]] if r.fields["WARC-Type"] == "revisit" else r
        full = bytes(origin.block).partition(b"\r\n\r\n")[2]
        assert (body == b"") if origin is not r else body == full
        assert r.fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(full).digest()).decode()
        assert head.endswith(f"Content-Length: {len(full)}".encode())


def test_damaged_payloads_and_empty_archives(spark, tmp_path):
    to = folder(tmp_path)
    warc.write_archive(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], PAGES), to)
    damaged = spark.read.parquet(f"{to}/payloads").selectExpr("sha256", "CASE WHEN payload = CAST('one' AS BINARY) THEN CAST('eno' AS BINARY) ELSE payload END AS payload")
    damaged.write.parquet(f"{to}/again/payloads")
    for part in ("headers", "spread"):
        spark.read.parquet(f"{to}/{part}").write.parquet(f"{to}/again/{part}")
    with pytest.raises(Exception, match="missing or damaged"):
        warc.read_archive(spark, f"{to}/again").collect()
    assert warc.archive_and_read(spark, spark.createDataFrame([], PAGES)).count() == 0


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """Levels of digests, from the leaves to the one that remains."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, k):
    """Left and right siblings of each level."""
    steps = []
    for level in levels[:-1]:
        run = level[k // 16 * 16 : k // 16 * 16 + 16]
        steps.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        k //= 16
    return steps


def plain_manifest(rows):
    leaf = lambda r, text: sha("".join(map(enc, (r[0], r[3], r[2], r[4], text))))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for k, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            r = x[3]
            steps = plain_path(trees[g], k) + plain_path(top, at)
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0 and r[1] is not None
            acc = leaf(r, r[1].translate(lower)) if tampered else x[2]
            for left, right in steps:
                acc = sha(left + acc + right)
            out.append((r[0], x[2], trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), acc, acc == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_manifest_against_plain_trees(spark, sources):
    rng = random.Random(sources)
    texts = ["", None, "Upper É", "lower", "A" * 50_000, "tie"]
    rows = [(rng.randrange(10**6), rng.choice(texts), rng.choice([None, "en", "ü"]), None if k % 11 == 0 else f"s{k * k % sources}", rng.choice([None, 0, -3])) for k in range(700)]
    rows += [(5, "same", "en", "s0", 1)] * 18 + [(5, "Other", "en", "s0", 1), (None, "X", None, None, None), (None, "X", None, "", None), (None, "x", None, "lonely", 2)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "text AS grp", "1 AS idx", "2 AS leaf", "doc_id AS id").repartition(3)
    got = merkle.document_manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == plain_manifest(rows)
    assert 0 < sum(r[-1] for r in found) < len(found)


@pytest.mark.parametrize("rows", [[], [(1, "A", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, None, None, None, None)]])
def test_small_manifests(spark, rows):
    got = merkle.document_manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == (plain_manifest(rows) if rows else [])


def test_numbers_of_groups_that_span_partitions(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(50)}", rng.randrange(500)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "grp string, v int").repartition(7)
    got = merkle.number(df, ["grp", "v"]).collect()
    for g, own in itertools.groupby(sorted(got, key=lambda r: (r.grp, r.idx)), key=lambda r: r.grp):
        own = list(own)
        assert [r.idx for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [r.v for r in own] == sorted(v for h, v in rows if h == g)


# Hard negatives

VECTORS = "vec_id long, label int, embedding array<double>"


def plain_negatives(rows, every=100, positives=5, negatives=10):
    ok = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in ok:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in ok if j != i))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            p = -s
            hits = [(k, -t) for t, k, other in scored if other != label and 30 * p <= 100 * -t <= 90 * p][:negatives]
            out += [(i, j, r, k, p, t) for r, (k, t) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("rows_per_block", "chunk", "panel"), [(4096, 32, 1 << 40), (16, 3, 1 << 40), (40, 5, 20_000)])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, rows_per_block, chunk, panel):
    for name, value in (("ROWS", rows_per_block), ("ANCHORS", 3), ("CHUNK", chunk)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(rows_per_block)
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in rng.normal(0.3, 0.5, 11)]) for i in range(230)]
    rows[7] = (7, 1, None)
    rows[8] = (8, None, rows[8][2])
    rows[9] = (9, 1, [*rows[9][2][:-1], math.nan])
    rows[11] = (11, 1, [None, *rows[11][2][1:]])
    rows[12] = (12, 1, [math.inf, *rows[12][2][1:]])
    rows[13] = (None, 1, rows[13][2])
    rows[20] = (20, 2, rows[20][2][:4])  # missing components count as zero
    rows[21] = (21, 2, [])
    rows[40:60] = [(40 + k, k % 4, rows[39][2]) for k in range(20)]  # ties
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS block", "2 AS tile").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, every=10, tile_bytes=panel).collect())
    assert got == plain_negatives(rows, every=10) and len(got) > 100


def test_copies_of_blocks_for_the_grid_are_not_sent(spark, monkeypatch):
    for name, value in (("ROWS", 16), ("ANCHORS", 4), ("WINDOWS", 15)):
        monkeypatch.setattr(hard_negatives, name, value, raising=False)
    plans, cut = [], hard_negatives.cut
    monkeypatch.setattr(hard_negatives, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in rng.normal(0.3, 0.5, 11)]) for i in range(200)]
    rows += [(200, 1, [2.0**16, 2.0**16, 1.0]), (201, 1, [2.0**16, 2.0**15, 1.0]), (202, 2, [2.0**15, 2.0**15, 1.0])]  # scores beyond 32 bits
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), every=10).collect())
    assert got == plain_negatives(rows, every=10) and max(r[-1] for r in got) >= 1 << 32
    assert plans and not any("Broadcast" in p and "Generate" in p for p in plans)


def test_hard_negatives_of_few_and_large_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert hard_negatives.hard_negatives(frame([])).count() == 0
    assert hard_negatives.hard_negatives(frame([(1, 1, [1.0])])).count() == 0
    assert hard_negatives.hard_negatives(frame([(100, 1, [1.0]), (200, 1, [2.0])])).count() == 0
    twice = [(100, 1, [1.0]), (100, 1, [1.0]), (1, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.5]), (2, 0, [0.5])]
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(frame(twice)).collect()) == sorted(plain_negatives(twice))
    big = [(0, 1, [2.0**22, 3.0]), (1, 1, [2.0**22, 0.0]), (2, 0, [2.0**21, 1.0]), (3, 0, [-1.0, 5.0])]
    assert [tuple(r) for r in hard_negatives.hard_negatives(frame(big)).collect()] == plain_negatives(big)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(frame([(0, 1, [1e40]), (1, 1, [1.0])])).collect()


def test_products_are_exact_in_all_ranges():
    rng = np.random.default_rng(3)
    for top in (100, 1 << 26, 1 << 29):
        a, b = rng.integers(-top, top, (5, 9)), rng.integers(-top, top, (4, 9))
        assert (hard_negatives.product(a, b) == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]).all()
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.product(np.full((1, 4), 1 << 31), np.full((1, 4), 1 << 31))


def test_quantised_rows():
    got, ok = hard_negatives.quantised(pa.array([[0.5, -0.001], None, [1.0], [math.nan, 0.0], [None, 0.0], []], pa.list_(pa.float32())), 2)
    assert ok.tolist() == [True, False, True, False, False, True]
    assert got[[0, 2, 5]].tolist() == [[128, -1], [256, 0], [0, 0]]
