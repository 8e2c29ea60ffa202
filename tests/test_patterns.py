"""Weighted site patterns against written-out replicates."""

import random

import pytest
from pyspark.sql import functions as F

from cladeweave.operators import distances, patterns, sites

SEQS = "marker string, name string, ord long, seq string"


def test_replicates_from_weights_equal_those_written_out(spark):
    rng = random.Random(3)
    columns = ["".join(rng.choice("ACGT-Nr") for _ in range(7)) for _ in range(9)]
    drawn = [rng.choice(columns) for _ in range(40)]
    rows = [("m", f"s{k}", 10 + k, "".join(c[k] for c in drawn)) for k in range(7)]
    rows[2] = (*rows[2][:3], rows[2][3][:25].lower())  # ends early, in lower case
    rows += [("n", "x", 1, "ACGT"), ("n", "y", 2, "ACGA"), ("n", "z", 3, None), ("e", "q", 1, "")]
    aln = spark.createDataFrame(rows, SEQS).repartition(3)
    found = patterns.site_patterns(aln)
    full = {k: (s or "").upper().ljust(40 if m == "m" else 4, "-") for m, k, _, s in rows}
    by = {}
    for r in found.collect():
        own = "".join(full[k][r.pos - 1] for m, k, _, _ in sorted(rows, key=lambda x: x[2]) if m == r.marker)
        by.setdefault((r.marker, own), set()).add((r.pattern, r.pos))
    for same in by.values():
        assert {p for p, _ in same} == {min(pos for _, pos in same)}
    weights = patterns.replicate_weights(aln, found, 4)
    written = sites.resample_columns(aln, 4)
    for rep in range(1, 5):
        one = written.where(f"replicate = {rep}")
        want = {r.marker: r for r in sites.marker_stats(one).collect()}
        got = {r.marker: r for r in patterns.replicate_statistics(aln, weights).where(f"replicate = {rep}").collect()}
        assert want.keys() == got.keys() == {"m", "n"}
        for m in want:
            assert all(want[m][c] == got[m][c] for c in want[m].asDict())
        pairs = {(r.marker, r.ord_i, r.ord_j): (r.valid, r.transitions, r.transversions) for r in distances.pair_counts(one, block=3).collect()}
        mine = {(r.marker, r.ord_i, r.ord_j): (r.valid, r.transitions, r.transversions) for r in patterns.replicate_pair_counts(aln, found, weights, block=3).where(f"replicate = {rep}").collect()}
        assert pairs == mine
    assert patterns.site_patterns(aln.limit(0)).count() == 0


@pytest.mark.parametrize(("width", "n"), [(40, 9), (40, 300), (700, 5)])
def test_distances_of_replicates_equal_those_of_counts(spark, width, n):
    """Also where sums of weights do not fit into one product (700 sites)."""
    rng = random.Random(width + n)
    columns = ["".join(rng.choice("ACGT-Nr") if rng.random() < 0.3 else "A" for _ in range(n)) for _ in range(width // 4)]
    drawn = [rng.choice(columns) for _ in range(width)]
    rows = [("m", f"s{k}", 10 + k, "".join(c[k] for c in drawn)) for k in range(n)]
    rows[2] = (*rows[2][:3], rows[2][3][:25].lower())
    rows += [("n", "x", 1, "ACGT"), ("n", "y", 2, "ACGA"), ("n", "z", 3, None), ("e", "q", 1, "")]
    aln = spark.createDataFrame(rows, SEQS).repartition(3)
    found = patterns.site_patterns(aln)
    weights = patterns.replicate_weights(aln, found, 3)
    counts = patterns.replicate_pair_counts(aln, found, weights).withColumn("marker", F.concat_ws("|", "marker", "replicate"))
    listed = lambda rows: sorted((*r[:-1], -1.0 if r[-1] is None else r[-1]) for r in rows)
    for which, block in (("k80", 100), ("jc69", 4096)):
        want = distances.distances(counts).select("marker", "ord_i", "ord_j", F.round(which, 9)).collect()
        got = patterns.replicate_pair_distances(aln, found, weights, which, block=block, places=9).select(F.concat_ws("|", "marker", "replicate"), "ord_i", "ord_j", which)
        assert listed(got.collect()) == listed(want) and len(want) == 3 * (n * (n - 1) // 2 + 1)
    assert got.rdd.getNumPartitions() == 4  # not merged by bytes


def test_replicate_distances_are_not_made_pair_by_pair_in_the_query(spark):
    from cladeweave.plans import catalogue

    plan = catalogue.QUERIES["replicate_k80"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan and "split" not in plan and "posexplode" in plan


def test_profiles_are_laid_out_in_bounded_slices(monkeypatch):
    """A batch of long texts is counted piece by piece, with the same sums."""
    import pyarrow as pa

    texts = ["ACGT" * k for k in range(1, 60)] + [None, "", "A" * 5000]
    batch = pa.record_batch([pa.array(["m"] * len(texts)), pa.array(texts, pa.string())], names=["marker", "seq"])
    monkeypatch.setattr(sites, "SLICE_CELLS", 400)
    pieces = list(sites._slices([batch]))
    assert sum(p.num_rows for p in pieces) == len(texts)
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 400 for p in pieces)
    got, want = {}, {}
    for out in sites._count_cells([batch]):
        for r in out.to_pylist():
            got[r["pos"], r["base"]] = got.get((r["pos"], r["base"]), 0) + r["n"]
    for x in texts:
        for k, c in enumerate(x or ""):
            want[k + 1, c] = want.get((k + 1, c), 0) + 1
    assert got == want
