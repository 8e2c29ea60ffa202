"""Screening, concatenation and dating as one call each, and the writers that go with them."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeweave.operators import clades, distances, sites, stages, trees
from cladeweave.sources import external, formats

SEQS = "marker string, name string, ord long, seq string"


def aligned(rng, marker, n, width, odd=None, rate=0.08, first=0):
    root = [rng.choice("ACGT") for _ in range(width)]
    rows = []
    for k in range(n):
        change = 0.9 if k == odd else rate
        seq = "".join(rng.choice("ACGTNacgt-") if rng.random() < change else x for x in root)
        rows.append((marker, f"{marker}_{k}", first + k, seq))
    return rows


def test_pair_sums_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = aligned(rng, "m", 23, 60, odd=4) + aligned(rng, "two", 2, 30, first=100) + aligned(rng, "one", 1, 30, first=200) + [("gap", "x", 300, "----"), ("gap", "y", 301, "NN"), ("gap", "z", 302, None)]
    aln = spark.createDataFrame(rows, SEQS)
    pairs = distances.distances(distances.pair_counts(aln, block=5))
    sums = distances.pair_sums(aln, block=5)
    assert sums.where("ord IS NULL").count() <= 20 < pairs.count()  # moments of blocks, not pairs
    near = lambda a, b: a == b or (a is not None and b is not None and a == pytest.approx(b))
    for one, two, key in (
        (distances.outliers(aln, pairs), distances.outliers_of_sums(aln, sums), ("marker", "ord")),
        (distances.saturation(pairs), distances.saturation_of_sums(aln, sums), ("marker",)),
    ):
        a, b = ({tuple(r[k] for k in key): r for r in df.collect()} for df in (one, two))
        assert a.keys() == b.keys() and all(near(a[k][c], b[k][c]) for k in a for c in one.columns)


@pytest.mark.parametrize("width", (0, 1, 120, 127, 128, 255, 256, 700, 5000))
def test_packed_counts_of_pairs(width):
    """One product has all three counts, in slices where a single one would not be exact."""
    rng = np.random.default_rng(width)
    codes = rng.choice(np.array([0, 1, 2, 3, 9], dtype=np.int8), (9, width))
    if width:
        codes[0] = codes[1] = 2  # as many sites as there are
    for transitions in (False, True):
        packing = distances._Packed(width, transitions)
        valid, ts, tv = packing.unpack(packing.counts(codes, codes, packing.right(codes)))
        for i in range(len(codes)):
            ok = (codes < 4) & (codes[i] < 4)
            differ, across = ok & (codes != codes[i]), ok & (codes // 2 != codes[i] // 2)
            assert valid[i].tolist() == ok.sum(axis=1).tolist() and (ts + tv)[i].tolist() == differ.sum(axis=1).tolist()
            assert not transitions or tv[i].tolist() == across.sum(axis=1).tolist()


def test_pairs_leave_tasks_as_arrays_and_are_rounded_there(spark):
    from cladeweave.plans import catalogue

    rng = random.Random(8)
    aln = spark.createDataFrame(aligned(rng, "m", 300, 30, rate=0.3) + aligned(rng, "n", 9, 700, first=1000), SEQS).repartition(3)
    counts = distances.distances(distances.pair_counts(aln)).collect()
    for which in ("k80", "k80_gamma", "jc69"):
        found = distances.pair_distances(aln, which, block=100, places=9)
        want = spark.createDataFrame([(r.marker, r.ord_i, r.ord_j, r[which]) for r in counts], "marker string, ord_i long, ord_j long, d double").select("marker", "ord_i", "ord_j", F.round("d", 9))
        assert sorted(tuple(r) for r in found.select("marker", "ord_i", "ord_j", F.coalesce(which, F.lit(-1.0))).collect()) == sorted((*r[:3], -1.0 if r[3] is None else r[3]) for r in want.collect())
        plan = catalogue.QUERIES[f"pair_{which}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "round(" not in plan and "posexplode" in plan


def test_half_up_rounds_as_spark_does(spark):
    values = [0.0, -0.0, 1.0000000005, 2.5e-9, 0.5e-9, 1.5e-9, -1.5e-9, 1e-300, 123456.7890123455, 9e15, 1e300, float("inf"), 0.30000000049999999, 0.1234567885]
    values += [random.Random(k).randrange(10**7) / 10**10 for k in range(500)] + [random.Random(k).expovariate(1) for k in range(500)]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", 9)).collect()]
    assert [str(x) for x in distances.half_up(np.array(values), 9).tolist()] == [str(x) for x in want]
    assert np.isnan(distances.half_up(np.array([np.nan]), 9)).all()


def test_pair_distances_equal_those_of_counts(spark):
    rng = random.Random(2)
    rows = aligned(rng, "m", 23, 60, odd=4) + aligned(rng, "wide", 5, 300, first=100) + [("gap", "x", 300, "----"), ("gap", "y", 301, "NN"), ("gap", "z", 302, None), ("gap", "u", 303, "A\u00e9G"), ("gap", "v", 304, "ACG")]
    aln = spark.createDataFrame(rows, SEQS)
    want = {(r.marker, r.ord_i, r.ord_j): r for r in distances.distances(distances.pair_counts(aln.where("ord < 303"), block=5)).collect()}
    for which in ("k80", "k80_gamma", "jc69"):
        got = {(r[0], r[1], r[2]): r[3] for r in distances.pair_distances(aln, which, block=5).collect()}
        assert got.pop(("gap", 303, 304)) == 0  # a letter outside ASCII is one cell
        got = {k: v for k, v in got.items() if k[2] < 303}
        assert got.keys() == want.keys()
        assert all(v == want[k][which] or v == pytest.approx(want[k][which]) for k, v in got.items())
    assert distances.pair_distances(aln, "jc69").rdd.getNumPartitions() == 4  # not merged by bytes


def test_profiles_of_ragged_and_lower_case_sequences(spark, monkeypatch):
    rows = [("m", "a", 1, "ACgt-N"), ("m", "b", 2, "ac"), ("m", "c", 3, None), ("n", "d", 4, ""), (None, "e", 5, "é日R"), ("m", "f", 6, "TTTTTTTT")]
    want: dict = {}
    for marker, _, _, seq in rows:
        for k, x in enumerate((seq or "").upper(), 1):
            want[marker, k, x] = want.get((marker, k, x), 0) + 1
    for cells in (1 << 22, 1):
        monkeypatch.setattr(sites, "TABLE_CELLS", cells)
        got = {(r.marker, r.pos, r.base): r.n for r in sites.base_counts(spark.createDataFrame(rows, SEQS)).collect()}
        assert got == want
    assert sites.base_counts(spark.createDataFrame([], SEQS)).count() == 0


def test_conserved_stretches_keep_long_runs(spark):
    noise = ["ACGTACGT", "CGTACGTA", "GTACGTAC", "TACGTACG"] * 3
    rows = [("m", f"s{k}", k, "AAAAACCCCC" + noise[k] + "GG" + noise[k] + "TTTTTTTTTT" + "-" * (6 if k % 4 else 0)) for k in range(12)]
    aln = spark.createDataFrame(rows + [("e", "x", 99, "")], SEQS)
    got = [(r.marker, r.stretch, r.first, r.last) for r in sites.conserved_stretches(aln, reach=1, min_information=1.1, max_gaps=0.4, min_length=6).orderBy("first").collect()]
    assert got == [("m", 1, 1, 10), ("m", 2, 29, 38)]
    kept = {r.name: r.seq for r in sites.mask_to_stretches(aln, reach=1, min_information=1.1, max_gaps=0.4, min_length=6).collect()}
    assert set(kept.values()) == {"AAAAACCCCCTTTTTTTTTT", ""} and kept["x"] == ""


def test_screening_in_one_call(spark):
    rng = random.Random(2)
    rows = aligned(rng, "good", 12, 90, odd=3) + aligned(rng, "short", 5, 20, first=50) + aligned(rng, "few", 3, 90, first=80)
    out = stages.run_marker_screening(spark.createDataFrame(rows, SEQS), min_length=60, min_sequences=6, keep_slope=0.0, flag_slope=-9.0)
    by = {r.marker: r for r in out["summary"].collect()}
    assert (by["good"].status, by["good"].decision, by["good"].n_original, by["good"].n_filtered, by["good"].removed) == ("processed_retained", "YES", 12, 11, "good_3")
    assert by["good"].missing_after < by["good"].missing_before and by["good"].slope_after is not None
    assert (by["short"].status, by["short"].decision_reason, by["short"].slope_before, by["short"].aln_len_before, by["short"].n_removed) == ("skipped_short_alignment", "alignment_shorter_than_50_columns", None, 20, 0)
    assert by["few"].decision == "NO" and "nseq_lt_6" in by["few"].decision_reason
    assert {r.name for r in out["retained"].collect()} == {f"good_{k}" for k in range(12) if k != 3}
    assert all(set(r.seq) <= set("ACGT-") for r in out["retained"].collect())


def text_of(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_concatenation_writes_all_files(spark, tmp_path):
    rows = [("matK", "Opuntia one|x|A1", 1, "acgt"), ("matK", "Opuntia two|x|A2", 2, "AC-T"), ("ITS", "Opuntia one|y|B1", 3, "GG"), ("ITS", "opuntia ONE|y|B9", 4, "TT"), ("ITS", "Cereus x|y|B3", 5, "NA")]
    records = spark.createDataFrame([("Opuntia one", "ingroup", True), ("Cereus x", "outgroup", True)], "species string, source_branch string, accepted_or_outgroup boolean")
    out = stages.run_concatenation_pipeline(spark.createDataFrame(rows, SEQS), records)
    matrix = {r.name: r.seq for r in out["supermatrix"].collect()}
    assert matrix == {"Opuntia_one": "GGACGT", "Opuntia_two": "--AC-T", "Cereus_x": "NA----"}
    summary = {r.species: r for r in out["final_species_alignment_summary"].collect()}
    assert (summary["Opuntia_one"].ITS, summary["Opuntia_one"].matK, summary["Opuntia_one"].pct_markers, summary["Opuntia_one"].species_class) == ("B1", "A1", 100.0, "ingroup")
    assert (summary["Opuntia_two"].ITS, summary["Opuntia_two"].species_class) == ("-", None)
    stages.write_concatenation(out, str(tmp_path))
    at = f"{tmp_path}/concatenated_alignments"
    assert text_of(spark, f"{at}/supermatrix.phy") == ["3 6", "Cereus_x NA----", "Opuntia_one GGACGT", "Opuntia_two --AC-T"]
    assert text_of(spark, f"{at}/supermatrix.fasta")[:2] == [">Cereus_x", "NA----"]
    assert text_of(spark, f"{at}/partition_raxml_ng.txt") == ["DNA, ITS = 1-2", "DNA, matK = 3-6"]
    assert text_of(spark, f"{at}/partition_mrbayes.nex") == ["#nexus", "begin mrbayes;", "   charset ITS = 1-2;", "   charset matK = 3-6;", "   partition combined = 2: ITS, matK;", "   set partition = combined;", "end;"]
    assert text_of(spark, f"{at}/partition_partitionfinder.cfg")[4:] == ["[data_blocks]", "ITS = 1-2;", "matK = 3-6;", "[schemes]", "search = greedy;"]
    assert "  DIMENSIONS NTAX=3 NCHAR=6;" in text_of(spark, f"{at}/supermatrix.nex")
    assert {(r.name, r.seq) for r in formats.read_fasta(spark, f"{tmp_path}/individual_markers").where("seq LIKE '--%'").collect()} == {("Opuntia_two", "--"), ("Cereus_x", "----")}
    assert spark.read.csv(f"{tmp_path}/final_tables/marker_statistics", header=True).count() == 2


def dating_program():
    """A stand-in that gives every branch twice its length (made here, as tasks get it by value)."""

    def stub(config, name):
        if "prime" in config.splitlines():
            return "opt = 2\noptad = 1\n"
        if "cv" in config.splitlines():
            return "chisq: (10) 5.0\nchisq: (1) 3.0\n"
        tree = re.search(r"treefile = (.*)", config)[1]
        if "bad" in tree:
            raise RuntimeError("no convergence")
        return re.sub(r":([0-9.]+)", lambda m: f":{2 * float(m[1])!r}", tree)

    return stub


def test_dating_of_best_tree_and_replicates(spark):
    best = "(out:2.0,(a:1.0,b:1.0)90:1.0,c:2.0);"  # unrooted
    reps = spark.createDataFrame([(1, best), (2, "(out:3.0,((a:1.0,c:1.0):1.0,b:2.0):1.0);"), (3, "(out:1.0,((a:1.0,bad:1.0):1.0,c:2.0):1.0);"), (4, "(a:1.0,b:1.0,c:3.0);")], "tree_no long, newick string")
    out = stages.run_dating(best, reps, dating_program(), "numsites = 10\n", ["out"], factor=10.0, primings=3)
    first = out["best"].first()
    assert first.smoothing == 1.0 and first.options == ["opt = 2", "optad = 1"]
    nodes = {r.label: r for r in trees.root_distances(formats.newick_nodes(spark.createDataFrame([("t", first.dated)], "tree_id string, newick string"))).join(formats.newick_nodes(spark.createDataFrame([("t", first.dated)], "tree_id string, newick string")), ["tree_id", "node_id"]).where("is_tip").collect()}
    assert {k: r.depth for k, r in nodes.items()} == {"out": 20.0, "a": 60.0, "b": 60.0, "c": 60.0}  # rooted half way along the outgroup's branch
    told = {r.tree_no: r.status for r in out["replicates"].collect()}
    assert told == {1: "OK", 2: "OK", 3: "ERROR: no convergence", 4: "OK"}
    ages = {r.n_tips: (r.n_replicates, r.support) for r in out["clade_ages"].collect()}
    assert ages[2] == (1, pytest.approx(1 / 3)) and ages[4] == (2, pytest.approx(2 / 3))
    assert stages.run_dating(best, reps, dating_program(), "numsites = 10\n", ["out"], n=2, primings=1)["replicates"].count() == 2


def test_annotated_trees_round_trip(spark):
    nodes = formats.newick_nodes(spark.createDataFrame([("t 1", "((a:1,'b c':2)0.9:1,d:3);")], "tree_id string, newick string"))
    marked = nodes.drop("comment").withColumn("clade", F.when(~F.col("is_tip"), "x[y]")).withColumn("range", F.when(F.col("node_id") == 1, F.array(F.lit(0.5), F.lit(2.0)))).withColumn("age", F.when(F.col("is_tip"), 1.5))
    texts = formats.newick_texts(marked, ["clade", "range", "age"])
    lines = [r.line for r in formats.tree_block(texts).orderBy("ord").collect()]
    assert lines[0] == "#NEXUS" and lines[2].startswith("  TREE t_1 = [&R] ((a[&age=1.5]:1.0") and lines[-1] == "END;"
    back = formats.newick_nodes(texts).withColumn("v", formats.comment_values("comment"))
    got = {r.node_id: (r.label if r.is_tip else r.support, r.branch_length, r.v) for r in back.collect()}
    assert got[1] == (0.9, 1.0, {"clade": "x_y_", "range": "{0.5,2.0}"}) and got[3] == ("b c", 2.0, {"age": "1.5"})
    plain = formats.newick_texts(nodes).first().newick
    assert plain == "((a:1.0,'b c':2.0)0.9:1.0,d:3.0);"


def test_rooting_by_tree(spark):
    texts = spark.createDataFrame([("s", "(a:1,(b:1,c:1):1,d:1);"), ("t", "(a:1,(b:1,c:1):1,d:1);")], "tree_id string, newick string")
    nodes = formats.newick_nodes(texts).drop("comment")
    outgroup = spark.createDataFrame([("s", "a"), ("t", "d")], "tree_id string, label string")
    rooted = trees.reroot(nodes, outgroup)
    tops = rooted.where("parent_id IS NULL").select("tree_id", F.col("node_id").alias("parent_id"))
    assert {(r.tree_id, r.label) for r in rooted.join(tops, ["tree_id", "parent_id"]).where("is_tip").collect()} == {("s", "a"), ("t", "d")}


def test_conservation_records_by_two_calls(spark):
    asked = []

    def read(url, headers):
        asked.append(url)
        assert headers["Authorization"] == "Bearer key"
        if "scientific_name" in url:
            return "{}" if "unknown" in url else '{"taxon": {"family_name": "F"}, "assessments": [{"assessment_id": 4, "latest": false}, {"assessment_id": 7, "latest": true, "red_list_category_code": "EN"}]}'
        return '{"criteria": "B1", "locations": []}'

    text = external.red_list_record("Opuntia x", "key", read)
    assert external.red_list_record("Opuntia", "key", read) is None and external.red_list_record("Opuntia unknown", "key", read) is None
    assert asked[0].endswith("genus_name=Opuntia&species_name=x") and asked[1].endswith("/assessment/7")
    from cladeweave.operators import registry

    row = registry.flatten_records(spark.createDataFrame([("Opuntia x", text)], "species_clean string, json string")).first()
    assert (row.iucn_found, row.iucn_category, row.iucn_criteria, row.iucn_family) == (True, "EN", "B1", "F")


def test_clade_ages_of_whole_sets(spark):
    nodes = formats.newick_nodes(spark.createDataFrame([("t", "((a:1,b:1):1,c:2);")], "tree_id string, newick string"))
    got = {r.n_tips: (r.n_replicates, r.mean_age) for r in clades.clade_age_intervals(nodes, nodes).collect()}
    assert got == {2: (1, 1.0), 3: (1, 2.0)}
