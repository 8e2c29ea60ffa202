"""Small fixtures: nulls, empty inputs, ties, and the properties of trees and alignments."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeweave.functions import names
from cladeweave.operators import concatenation, curation, dating, distances, integration, registry, sites, taxa, trees
from cladeweave.plans import catalogue
from cladeweave.sources import external, formats
from cladeweave.streaming import cache


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_name_functions(spark):
    rows = [(" Genus sp. two ",), (None,), ("",), ("Genus_species more|x|S12",), ("a_b",)]
    got = values(spark, rows, "t string", names.clean_species_name("t"), names.header_species("t"), names.header_accession("t"), names.first_binomial("t"), names.clean_taxon_name("t"))
    assert got[0] == ("_Genus_sp_two_", "Genus_sp._two", "-", " Genus sp. two ", "Genus_sp_two")
    assert got[1][:2] == (None, None)
    assert got[2][:2] == ("", None)
    assert got[3] == ("Genus_species_more|x|S12", "Genus_species_more", "S12", "Genus_species", "Genus_species_more")


def test_accepted_names_and_the_compatible_form(spark):
    rows = [("Opuntia maxima",), ("Opuntia ficus",), ("Opuntia x rara",), ("Opuntia cf. rara",), ("opuntia rara",), (None,), ("  Opuntia   ficus ",)]
    got = values(spark, rows, "t string", names.is_accepted_name("t"), names.is_accepted_name("t", compat=True))
    assert got == [(True, False), (True, True), (False, False), (False, False), (False, False), (False, False), (True, True)]


def test_exclusion_terms_are_seen_in_whole_texts(spark, tmp_path):
    long = "a plain beginning of more than forty characters "
    rows = [(5, long + "unverified end"), (6, long), (11, long + "end"), (15, long + "end"), (17, None), (None, long + "(var.)")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["excluded_records"](spark, str(tmp_path)).collect()}
    assert got == {(5, True), (6, True), (11, False), (15, True), (17, False), (None, True)}


def test_marker_pattern_is_longest_first(spark):
    pattern = names.marker_pattern(["trnL", "trnL-trnF", "trnS(GCU)-trnG(UUC)", "trnL", ""])
    got = values(spark, [("trnF trnL-trnF and trnL, trnL-trnF trnS(GCU)-trnG(UUC)",), (None,), ("none",)], "t string", names.marker_text("t", pattern))
    assert got == [("trnL-trnF, trnL, trnS(GCU)-trnG(UUC)",), ("",), ("",)]


def test_age_labels_keep_the_sign_of_zero(spark):
    df = spark.createDataFrame([(-0.04,), (-0.05,), (-0.06,), (0.04,), (0.0,), (-1.96,), (None,)], "age double")
    assert [r[0] for r in df.select(names.age_label("age")).collect()] == ["-0", "-0", "-0.1", "0", "0", "-2", None]


def test_age_labels_and_support_classes(spark):
    assert [r[0] for r in values(spark, [(2.0,), (2.25,), (2.75,)], "a double", names.age_label("a"))] == ["2", "2.2", "2.8"]
    assert values(spark, [(0.9,), (0.7,), (0.1,), (None,)], "s double", names.support_class("s")) == [(">= 90",), ("70-89",), ("< 70",), ("< 70",)]


MEMBERS = "cluster_id int, sid string, species string, parent string, ord int"


def test_keepers(spark):
    m = spark.createDataFrame([(1, "a", "x", "9", 1), (2, "a", "y", "3", 2), (3, "a", "y", "3", 3), (1, "b", "x", None, 4), (2, "b", "x", "9", 5), (5, "c", "x", "3", 6)], MEMBERS)
    both = {(r.cluster_id, r.sid) for r in curation.keep_preferred_parent(m, "3").collect()}
    assert both == {(2, "a"), (3, "a"), (1, "b")}
    assert {(r.cluster_id, r.sid) for r in curation.keep_first_ranked(m, "3").collect()} == {(2, "a"), (1, "b")}
    manual = spark.createDataFrame([(1, "a", "by hand"), (5, "c", "by hand")], "cluster_id int, sid string, reason string")
    gone = {(r.cluster_id, r.sid): r.reason for r in curation.removals(m, curation.keep_preferred_parent(m, "3"), manual).collect()}
    assert gone == {(1, "a"): "automatic duplicate resolution", (2, "b"): "automatic duplicate resolution", (5, "c"): "by hand"}
    conflicts = {r.sid: (r.n_clusters, r.clusters, r.species) for r in curation.accession_conflicts(m).collect()}
    assert conflicts == {"a": (3, "1,2,3", "x,y"), "b": (2, "1,2", "x")}
    assert curation.accession_conflicts(m.limit(0)).count() == 0


ALN = "marker string, name string, ord int, seq string"


def test_two_definitions_of_informative_sites(spark):
    aln = spark.createDataFrame([("m", "a", 1, "AA-NAa-C"), ("m", "b", 2, "AC-NArNC"), ("m", "c", 3, "ACGNCCNG"), ("m", "d", 4, "AAGNAC-G")], ALN)
    screen = sites.screening_stats(aln).collect()[0]
    assert (screen.total_cols, screen.aln_len, screen.var_sites, screen.pi_sites) == (8, 6, 4, 4)
    plain = sites.marker_stats(aln).collect()[0]
    assert (plain.n_taxa, plain.variable_sites, plain.parsimony_informative, plain.invariant_sites) == (4, 4, 2, 2)
    assert plain.variable_sites + plain.invariant_sites + 2 == 8
    kept = {r.name: r.seq for r in sites.drop_common_gaps(aln).collect()}
    assert kept["c"] == "ACGNCCNG"


def test_filters_and_empty_alignments(spark):
    aln = spark.createDataFrame([("m", "a", 1, "ACGT"), ("m", "b", 2, "A---"), ("m", "c", 3, "NNAC"), ("e", "z", 1, "")], ALN)
    log = {(r.marker, r.name): (r.removed_low_coverage, r.removed_high_missingness, r.removed_final) for r in sites.filter_sequences(aln).collect()}
    assert log == {("m", "a"): (False, False, False), ("m", "b"): (True, False, True), ("m", "c"): (False, True, True), ("e", "z"): (True, True, True)}
    assert sites.stage_stats(aln.limit(0)).count() == 0


def test_distances_against_formulas(spark):
    aln = spark.createDataFrame([("m", "a", 1, "ACGTACGTAC"), ("m", "b", 2, "GCGTACGTAA"), ("m", "c", 3, "ACGT-CGNAC"), ("m", "d", 4, "TTTTTTTTTT")], ALN)
    got = {(r.ord_i, r.ord_j): r for r in distances.distances(distances.pair_counts(aln, block=2)).collect()}
    assert len(got) == 6 and got[1, 3].k80 == 0
    p, q = 0.1, 0.1
    assert got[1, 2].k80 == pytest.approx(-0.5 * math.log(1 - 2 * p - q) - 0.25 * math.log(1 - 2 * q))
    assert got[1, 2].k80_gamma == pytest.approx(0.5 * (1 / (1 - 2 * p - q) + 0.5 / (1 - 2 * q) - 1.5))
    assert got[1, 4].k80 is None and got[1, 4].jc69 is None
    slope = distances.saturation(distances.distances(distances.pair_counts(aln.limit(2)))).collect()[0]
    assert (slope.slope, slope.reason) == (None, "insufficient_data")


def test_ranges_follow_case_insensitive_names(spark):
    aln = spark.createDataFrame([("matK", "a", 1, "AAAA"), ("ITS", "a", 1, "AA"), ("atpB", "b", 1, "A")], ALN)
    ranges = {r.marker: (r.start, r.end) for r in concatenation.marker_ranges(aln).collect()}
    assert ranges == {"atpB": (1, 1), "ITS": (2, 3), "matK": (4, 7)}
    rows = {r.name: r.seq for r in concatenation.supermatrix(aln, concatenation.marker_ranges(aln)).collect()}
    assert rows == {"a": "-AAAAAA", "b": "A------"}
    lines = {(r.format, r.marker): r.line for r in concatenation.partition_lines(concatenation.marker_ranges(aln)).collect()}
    assert lines["raxml", "ITS"] == "DNA, ITS = 2-3" and lines["mrbayes", "matK"] == "   charset matK = 4-7;"


def test_sequence_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "MARKER_x1.fasta").write_text(">a one\nAC\nGT\n>b\n\nTT\r\n")
    got = [(r.marker, r.name, r.seq) for r in formats.read_fasta(spark, f"{tmp_path}/in").orderBy("ord").collect()]
    assert got == [("x1", "a one", "ACGT"), ("x1", "b", "TT")]
    matrix = spark.createDataFrame([("b", "AC"), ("a", "GT")], "name string, seq string")
    formats.write_lines(formats.phylip_lines(matrix), f"{tmp_path}/p")
    assert [r.value for r in spark.read.text(f"{tmp_path}/p").collect()] == ["2 2", "a GT", "b AC"]
    assert {(r.name, r.seq) for r in formats.read_phylip(spark, f"{tmp_path}/p").collect()} == {("a", "GT"), ("b", "AC")}
    text = [r.line for r in formats.nexus_lines(matrix).orderBy("ord").collect()]
    assert text[0] == "#NEXUS" and text[-1] == "END;" and "    a GT" in text


TREES = ["((a:1,b:2)0.9:1,(c,d)0.5,e);", "(a,'b c',(d,(e,f)x)'it''s':2.5)r;", "(((((a))),b));", "a;", "(a:1e-3[&k=1],b:2)[c];"]


def test_newick_round_trip_and_errors():
    for text in TREES:
        nodes = formats.parse_newick(text)
        assert formats.parse_newick(formats.format_newick(nodes)) == nodes
    deep = "(" * 5000 + "a" + ",b)" * 5000 + ";"
    assert len(formats.parse_newick(formats.format_newick(formats.parse_newick(deep)))) == len(formats.parse_newick(deep))
    for bad in ("(a,b;", "a,b;", "a);"):
        with pytest.raises(ValueError):
            formats.parse_newick(bad)


def spark_upper(column):
    return F.upper(column)


def nodes_of(spark, *texts):
    return formats.newick_nodes(spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "tree_id string, newick string"))


def split_sets(spark, *texts):
    found = {}
    for r in trees.splits(nodes_of(spark, *texts)).collect():
        found.setdefault(r.tree_id, set()).add(r.split)
    return found


def test_splits_ignore_the_root(spark):
    got = split_sets(spark, "((a,b),(c,(d,e)));", "(a,b,(c,(d,e)));", "(a,b,c,d,e);", "((a,c),(b,(d,e)));")
    assert got["t0"] == got["t1"] == {"c,d,e", "d,e"} and "t2" not in got and got["t3"] == {"b,d,e", "d,e"}


def test_distances_are_over_the_common_tips_of_each_pair(spark):
    texts = ["((a,b),(c,(d,e)));", "(a,b,(c,(d,e)));", "(a,(b,x));", "((a,c),(b,(d,(e,f))));", "((a,b),(c,d),g);"]
    nodes = nodes_of(spark, *texts)
    order = spark.createDataFrame([(f"t{k}", k) for k in range(5)], "tree_id string, ord int")
    sets = nodes.where("is_tip").selectExpr("'X' AS analysis_id", "tree_id AS tree", "label", "label AS taxon")
    got = {(r.tree_1, r.tree_2): (r.n_common_tips, r.rf, r.dpi) for r in trees.pairwise_distances(nodes, sets, order).collect()}
    assert len(got) == 10
    assert got["t1", "t0"][:2] == (5, 0.0) and got["t1", "t0"][2] == pytest.approx(0)
    # f is left out against t0, x and c to e against t2; two common tips are too few.
    assert got["t3", "t0"][:2] == (5, 0.5) and got["t2", "t0"] == (2, None, None)
    assert got["t4", "t0"][:2] == (4, 0.0) and got["t4", "t3"][:2] == (4, 1.0)
    renamed = sets.where("tree != 't2'").withColumn("taxon", spark_upper("label"))
    again = {(r.tree_1, r.tree_2): r.rf for r in trees.pairwise_distances(nodes, renamed, order, dpi=False).collect()}
    assert again == {k: v[1] for k, v in got.items() if "t2" not in k}
    assert trees.pairwise_distances(nodes, sets.limit(0), order).count() == 0


def test_genus_trees_and_tip_set_guards(spark):
    nodes = nodes_of(spark, "(((G_a,G_b),H_a),(I_a,J_a));", "((G_b,H_b),I_a);")
    tips = nodes.where("is_tip").selectExpr("tree_id AS tree", "label AS taxon")
    sets = taxa.analysis_tips(tips, ["t0", "t1"], ["t0", "t1"])
    assert {(r.tree, r.label, r.taxon) for r in sets.where("analysis_id = 'A4'").collect()} == {("t0", "G_a", "G"), ("t1", "G_b", "G"), ("t0", "H_a", "H"), ("t1", "H_b", "H"), ("t0", "I_a", "I"), ("t1", "I_a", "I")}
    small = trees.rename_tips(nodes, sets.where("analysis_id = 'A4'").selectExpr("tree AS tree_id", "label", "taxon")).collect()
    assert sorted((r.tree_id, r.label) for r in small if r.is_tip) == [(t, g) for t in ("t0", "t1") for g in "GHI"] and len(small) == 10
    taxa.require_equal_sets(tips, tips)
    with pytest.raises(ValueError, match="J_a"):
        taxa.require_equal_sets(tips.where("tree = 't0'"), tips.where("tree = 't1'"), shown=20)


@given(st.integers(1, 5), st.integers(0, 3), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_assignment_is_optimal(n, extra, seed):
    cost = np.random.default_rng(seed).integers(-5, 6, (n, n + extra)).astype(float)
    best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n + extra), n))
    assert trees.assignment(cost) == pytest.approx(best)


def test_information_distance_properties():
    one = np.array([[1, 1, 0, 0, 0, 0], [0, 0, 0, 0, 1, 1], [0, 0, 0, 1, 1, 1]])
    two = np.array([[1, 0, 1, 0, 0, 0], [0, 0, 0, 0, 1, 1]])
    d = trees.phylogenetic_information_distance
    assert d(one, one) == pytest.approx(0) and d(one, 1 - one) == pytest.approx(0)
    assert d(one, two) == pytest.approx(d(two, one)) and 0 < d(one, two) < 1
    assert d(np.zeros((0, 6)), np.zeros((0, 6))) == 0


def test_mrca_and_monophyly(spark):
    nodes = nodes_of(spark, "(((a,b),c),(d,e));")
    groups = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "a"), ("g2", "c"), ("g3", "d"), ("g4", "a"), ("g4", "e"), ("g1", "zz")], "grp string, tip string")
    got = {r.grp: (r.n_tips, r.n_below, r.monophyletic) for r in trees.group_nodes(nodes, groups).collect()}
    assert got == {"g1": (2, 2, True), "g2": (2, 3, False), "g4": (2, 5, False)}


def test_collapse_prune_depth_reroot(spark):
    nodes = nodes_of(spark, "(((a:1,b:1)0.5:1,c:2)0.95:1,(d:1,e:1)0.8:3);")
    flat = {r.node_id: r for r in trees.collapse(nodes, 0.7).collect()}
    tips = {r.label: r for r in flat.values() if r.is_tip}
    assert tips["a"].parent_id == tips["c"].parent_id and len(flat) == len(nodes.collect()) - 1
    assert trees.max_depth(nodes).collect()[0].max_depth == 4
    kept = trees.prune(nodes, spark.createDataFrame([("a",), ("c",), ("d",)], "tip string")).collect()
    assert {r.label: r.branch_length for r in kept if r.is_tip} == {"a": 2.0, "c": 2.0, "d": 4.0}
    rooted = trees.reroot(nodes, ["c"])
    assert {r.note for r in rooted.collect()} == {"rooted"}
    assert split_sets(spark, "(((a,b),c),(d,e));")["t0"] == {r.split for r in trees.splits(rooted.drop("note")).collect()}
    assert {r.note for r in trees.reroot(nodes, ["q"]).collect()} == {"outgroup absent"}


def test_supports(spark):
    ref = nodes_of(spark, "((a,b),(c,d),(e,(f,g)));")
    reps = nodes_of(spark, "((a,b),(c,d),(e,(f,g)));", "((a,c),(b,d),(e,(f,g)));")
    fbp = {r.split: r.support for r in trees.support_fbp(ref, reps).collect()}
    tbe = {r.split: r.support for r in trees.support_tbe(ref, reps).collect()}
    assert fbp["f,g"] == tbe["f,g"] == 1 and fbp["c,d"] == 0.5 and all(tbe[s] >= fbp[s] - 1e-12 for s in fbp)
    assert set(fbp) == set(tbe) == {r.split for r in trees.splits(ref).collect()}
    # A replicate without any split counts.
    star = trees.support_fbp(ref, nodes_of(spark, "((a,b),(c,d),(e,(f,g)));", "(a,b,c,d,e,f,g);")).collect()
    assert {r.support for r in star} == {0.5}


def test_bootstopping_halves(spark):
    same = ["((a,b),(c,d),(e,(f,g)));"] * 6
    r = trees.convergence(nodes_of(spark, *same)).collect()[0]
    assert (r.mean_wrf, r.share_within, r.converged) == (0.0, 1.0, True)
    r = trees.convergence(nodes_of(spark, *same[:3], *["((a,c),(b,d),(e,(f,g)));"] * 3), permutations=40).collect()[0]
    # Halves of three and three: two of four splits differ in a third of the counts at least.
    assert not r.converged and 1 / 6 <= r.mean_wrf <= 0.5


def test_tree_space(spark):
    schema = "tree_1 string, tree_2 string, distance double"
    pts = {r.tree: (r.dimension_1, r.dimension_2) for r in trees.tree_space(spark.createDataFrame([("b", "a", 3.0), ("c", "a", 4.0), ("c", "b", 5.0)], schema)).collect()}
    assert math.dist(pts["a"], pts["b"]) == pytest.approx(3) and math.dist(pts["b"], pts["c"]) == pytest.approx(5)
    assert trees.tree_space(spark.createDataFrame([("b", "a", None)], schema)).count() == 0
    with pytest.raises(ValueError):
        trees.tree_space(spark.createDataFrame([("b", "a", None), ("c", "a", 1.0)], schema))


def test_constraint_tree(spark):
    aln = spark.createDataFrame([("x",), ("y",), ("z",)], "taxon string")
    clades = spark.createDataFrame([("x", "A"), ("y", "A"), ("z", "B"), ("q", "C"), ("x", "B")], "taxon string, clade string")
    groups = taxa.constraint_groups(aln, clades.where("NOT (taxon = 'x' AND clade = 'B')"))
    assert taxa.constraint_tree(groups, "({A},{B});") == "((x,y),z);"
    with pytest.raises(ValueError):
        taxa.constraint_tree(groups, "({A},{C});")
    absent, double = taxa.clade_audit(aln, clades)
    assert absent.count() == 0 and [(r.taxon, r.clades) for r in double.collect()] == [("x", "A;B")]


def test_dating_helpers(spark):
    plan = dating.bootstrap_plan(spark)
    assert [(r.replicate, r.seed) for r in plan.collect()] == [(1, 1111), (2, 2111), (3, 3111), (4, 4111)]
    assert "--seed 4111" in dating.bootstrap_script(plan, "tool")
    ages = spark.createDataFrame([(1, k, float(k if k < 20 else 100)) for k in range(1, 21)], "node int, rep int, age double")
    r = dating.age_intervals(ages).collect()[0]
    assert (r.hpd_low, r.hpd_high) == (1.0, 19.0)
    conf = spark.createDataFrame([(1, 1, "smoothing = 10"), (1, 2, "x = 1"), (1, 3, "smoothing = 0.1")], "run int, line_no int, line string")
    assert dating.last_smoothing(conf).collect()[0].smoothing == 0.1
    assert {r.key: r.value for r in formats.parse_config(conf.drop("run")).collect()} == {"smoothing": "0.1", "x": "1"}


def test_conservation_records(spark):
    full = '{"taxon": {"family_name": "F", "common_names": [{"name": "n"}, {"name": null}, {"name": "n"}]}, "assessments": [{"assessment_id": 1, "latest": false, "red_list_category_code": "LC"}, {"assessment_id": 2, "latest": true, "red_list_category_code": "EN"}], "assessment": {"locations": [{"description": {"en": "X"}, "code": "x", "is_endemic": true}, {"description": {"en": "Y"}, "code": "y", "is_endemic": false}, {"description": {"en": "X"}, "code": "x", "is_endemic": true}]}}'
    df = spark.createDataFrame([("a", full), ("b", '{"assessments": []}'), ("c", None), ("d", "junk"), ("e", '{"assessments": [{"assessment_id": 3, "red_list_category_code": "VU"}]}')], "species_clean string, json string")
    got = {r.species_clean: r for r in registry.flatten_records(df).collect()}
    assert len(registry.flatten_records(df).columns) == 37
    a = got["a"]
    assert (a.iucn_category, a.iucn_common_name, a.iucn_locations, a.iucn_endemic_locations, a.iucn_num_locations, a.iucn_is_endemic) == ("EN", "n", "X; Y", "X", 2, True)
    assert [got[k].iucn_found for k in "bcd"] == [False] * 3 and got["e"].iucn_category == "VU" and got["e"].iucn_is_endemic is False


def test_integration_with_nothing(spark):
    headers = spark.createDataFrame([], "marker_key string, source_branch string, species string, fasta_name string")
    metadata = spark.createDataFrame([], "species string, marker_key string, sid string, is_outgroup boolean")
    flagged = integration.with_acceptance(integration.raw_records(headers, metadata), spark.createDataFrame([], "species string"), metadata)
    assert integration.select_records(flagged).count() == 0 and integration.duplicate_groups(flagged).count() == 0


def test_external_commands_and_fetching(spark):
    assert external.raxml_support("t", "b", "p")[:2] == ["raxml-ng", "--support"]
    with pytest.raises(FileNotFoundError):
        external.run(["no-such-program-here"])
    with pytest.raises(RuntimeError):
        external.run(["false"])
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "sid string")
    known = spark.createDataFrame([("a", "old", "d"), ("z", "zz", "d")], "sid string, species_gb string, description_gb string")
    got = external.fetch_metadata(wanted, known, lambda ids: [(i, "new", "d") for i in ids], pause=0.0).collect()
    assert {(r.sid, r.species_gb) for r in got} == {("a", "old"), ("b", "new")}
    tries = []
    with pytest.raises(OSError):
        external.with_retries(lambda b: tries.append(1) or (_ for _ in ()).throw(OSError()), [], 3, 0.0)
    assert len(tries) == 3
    aligned = external.align_groups(spark.createDataFrame([("m", "a", 1, "AC"), ("m", "b", 2, "GT")], "marker string, name string, ord long, seq string"), ["cat"]).collect()
    assert {(r.name, r.seq, r.status) for r in aligned} == {("a", "AC", "OK"), ("b", "GT", "OK")}


def test_growing_cache(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "sid string, v int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).write.parquet(source)
    run = lambda: cache.grow_cache(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/c", f"{tmp_path}/k").awaitTermination()
    run()
    spark.createDataFrame([("a", 2), ("c", 2)], schema).write.mode("append").parquet(source)
    run()
    assert {(r.sid, r.v) for r in cache.read_cache(spark, f"{tmp_path}/c").collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_resume_reads_a_complete_stage(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert external.once(spark, f"{tmp_path}/s", make).count() == external.once(spark, f"{tmp_path}/s", make).count() == 3
    assert len(made) == 1


def test_unique_in_order_is_stable(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "b", 9), (1, None, 1)], "g int, v string, o int")
    r = df.groupBy("g").agg(names.unique_in_order("v", "o", ",").alias("x"), names.unique_sorted("v").alias("y")).collect()[0]
    assert (r.x, r.y) == ("b,a", "a;b")
