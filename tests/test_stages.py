"""Whole stages, guards, and the formats that feed them, on small inputs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from cladeweave.operators import dating, guards, sites, stages, trees
from cladeweave.sources import external, formats
from cladeweave.streaming import cache

MEMBER = "cluster_id int, sid string, species string, parent string, ord int"
SEQS = "marker string, name string, ord int, seq string"


def members(spark):
    rows = [(1, f"s{k}", f"Sp_{k}", "3593", k) for k in range(6)] + [(2, "s0", "Sp_0", "77", 10), (2, "s1", "Sp_9", "77", 11), (3, "t", "Sp_7", None, 12)]
    meta = [(f"s{k}", "trnL gene" if k % 2 else "matK and trnL") for k in range(6)] + [("t", None)]
    return (
        spark.createDataFrame(rows, MEMBER),
        spark.createDataFrame(meta, "sid string, description string"),
        spark.createDataFrame([(1, "s5", "by hand")], "cluster_id int, sid string, reason string"),
        spark.createDataFrame([("matK, trnL", "matK", 1)], "search string, replace string, ord int"),
    )


def test_assembly(spark, tmp_path):
    m, meta, manual, dictionary = members(spark)
    t = stages.assemble_ingroup(m, meta, manual, ["matK", "trnL"], dictionary, min_species=1)
    assert {(r.cluster_id, r.sid, r.reason) for r in t["removed"].collect()} == {(2, "s0", "automatic duplicate resolution"), (2, "s1", "automatic duplicate resolution"), (1, "s5", "by hand")}
    assert {r.sid for r in t["members_clean"].collect()} == {"s0", "s1", "s2", "s3", "s4"}
    assert [(r.cluster_id, r.n_original, r.n_removed, r.n_final) for r in t["cluster_counts"].orderBy("cluster_id").collect()] == [(1, 6, 1, 5), (2, 2, 2, 0)]
    summary = t["cluster_summary_clean"].collect()
    assert [(r.cluster_id, r.top_marker, r.n_sequences) for r in summary] == [(1, "matK", 5)]
    assert {(r.species, r.Marker_std) for r in t["accession_occupancy"].collect()} == {(f"Sp_{k}", "matK") for k in range(5)}
    stages.write_tables(t, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/duplicate_conflicts").count() == 2
    out = stages.assemble_outgroup(m, meta, manual.limit(0), ["matK"], dictionary, preferred="77")
    assert {(r.cluster_id, r.sid) for r in out["removed"].collect()} == {(1, "s0"), (1, "s1")}
    with pytest.raises(ValueError, match="parent"):
        stages.assemble_ingroup(m.drop("parent"), meta, manual, ["x"], dictionary)


def aligner(bad=()):
    return lambda rows: rows.withColumn("seq", F.rpad("seq", 12, "-")).withColumn("status", F.when(F.col("marker").isin(*bad), "ERROR: no luck").otherwise("OK") if bad else F.lit("OK"))


def raw(spark):
    rows = [("m", f"n{k}", k, "ACGTACGTAC") for k in range(12)] + [("m", "short", 20, "A"), ("m", "odd", 21, "NNNNNNNNAC"), ("e", "x", 1, "ACGT"), ("m", None, 22, "ACGTACGTAC"), ("m", None, 22, "ACGTRCGTAC")]
    return spark.createDataFrame(rows, SEQS)


def test_alignment_pipeline_keeps_going(spark):
    t = stages.run_alignment_pipeline(raw(spark), aligner(["e"]))
    rows = {r.marker: r for r in t["manifest"].collect()}
    assert rows["e"].status == "ERROR: no luck" and rows["e"].n_sequences_raw_input is None and rows["e"].masking_applied and not rows["e"].final_alignment_written
    assert rows["m"].status == "OK" and rows["m"].n_sequences_raw_input == 16 and rows["m"].n_sequences_final_filtered == 14
    assert (rows["m"].alignment_length_mafft_aligned, rows["m"].alignment_length_common_gap_removed) == (12, 10)
    kept = t["final"].collect()
    assert {r.name for r in kept} == {f"n{k}" for k in range(12)} | {None} and sum(r.name is None for r in kept) == 2
    plain = stages.run_alignment_pipeline(raw(spark), aligner(), mask=False)
    rows = {r.marker: r for r in plain["manifest"].collect()}
    assert {r.status for r in rows.values()} == {"OK_NO_MASK"} and not rows["m"].masking_applied and rows["m"].n_sequences_masked_alignment == 16
    assert {c for c, _ in t["manifest"].dtypes} == {c for c, _ in plain["manifest"].dtypes}


def test_joint_realignment_names_failures(spark):
    t = stages.run_joint_realignment(raw(spark).where("marker = 'm'").unionByName(spark.createDataFrame([("gone", "x", 1, "NNNNNNNN")], SEQS)), aligner())
    assert [r.marker for r in t["collapsed"].collect()] == ["gone"] and t["final"].where("marker = 'm'").count() == 14
    with pytest.raises(RuntimeError, match="e: ERROR"):
        stages.run_joint_realignment(raw(spark), aligner(["e"]))


def test_integration_stage(spark):
    headers = spark.createDataFrame([("M1", "ingroup", "Opuntia_a", "Opuntia_a|1"), ("M1", "ingroup", "Opuntia_b", "Opuntia_b|2"), ("M1", "outgroup", "Out_x", "Out_x|3")], "marker_key string, source_branch string, species string, fasta_name string")
    meta = spark.createDataFrame([("Opuntia_a", "M1", "1", False), ("Opuntia_a", "M1", "1", False), ("Opuntia_b", "M1", "2", False), ("Out_x", "M1", "3", True)], "species string, marker_key string, sid string, is_outgroup boolean")
    checklist = spark.createDataFrame([("Opuntia a",), ("Opuntia a",)], "pureName string")
    t = stages.integrate_and_clean_markers(headers, meta, checklist.selectExpr("replace(pureName, ' a', ' a') AS pureName"))
    assert {r.fasta_name for r in t["exported_records"].collect()} == {"Opuntia_a|1", "Out_x|3"}
    assert t["sequence_registry"].count() == 3  # repeated metadata does not repeat records
    assert t["marker_summary"].collect()[0].n_sequences_exported == 2
    with pytest.raises(ValueError, match="no ingroup"):
        stages.integrate_and_clean_markers(headers.where("source_branch = 'outgroup'"), meta, checklist)


def test_validation_stage(spark):
    texts = ["(((A_a:1,A_b:1):1,B_a:2):1,(C_a:1,D_a:1):2);", "(((A_a:1,B_a:1):1,A_b:2):1,(C_a:1,D_a:1):2,Z_z:1);", "((A_a:1,B_b:1):1,(C_a:1,D_a:1):2);"]
    nodes = formats.newick_nodes(spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "tree_id string, newick string"))
    order = spark.createDataFrame([(f"t{k}", k) for k in range(3)], "tree_id string, ord int")
    every = spark.createDataFrame([(x,) for x in ("A_a", "A_b", "B_a", "B_b", "C_a", "D_a")], "taxon string")
    t = stages.validate_phylogenies(nodes, order, every, every, ["t0", "t1"], spark.createDataFrame([("D_a",)], "taxon string"))
    far = {(r.analysis_id, r.metric, r.tree_1, r.tree_2): (r.n_common_tips, r.distance) for r in t["pairwise_distances"].collect()}
    assert far["A2", "RF", "t1", "t0"] == (5, 0.5) and far["A1", "RF", "t1", "t0"] == (3, 0.0) and far["A4", "RF", "t2", "t0"] == (4, 0.0)
    assert len(far) == 2 * (3 + 1 + 3 + 3)
    assert {r.rooting_notes for r in t["rooting_summary"].collect()} == {"rooted"}
    assert {(r.analysis_id, r.metric) for r in t["tree_space"].collect()} == {(a, m) for a in ("A1", "A2", "A3", "A4") for m in ("RF", "DPI")}
    assert [r.species for r in t["species_removed"].collect()] == ["Z_z"]


def test_dating_runs_prime_then_validate_then_date(spark):
    seen = []

    def run(config, name):
        seen.append((name, config))
        if name.startswith("prime"):
            return "x\nopt = 3\noptad = 2\n" if name != "prime_1" else "opt = 1\noptad = 1"
        if name == "cv":
            return "chisq: (1000) 5.5\nchisq: (10) 2.5\nchisq: (1) 2.5\n"
        return f"dated {name}"

    out, smoothing, options = dating.date_tree(run, "numsites = 9\nsmooth = 4\nmrca = a b\n", "t.tre", "ML", primings=3)
    assert (out, smoothing, options) == ("dated final", 1.0, ["opt = 3", "optad = 2"])
    assert [n for n, _ in seen] == ["prime_0", "prime_1", "prime_2", "cv", "final"]
    assert seen[-1][1] == "treefile = t.tre\nnumsites = 9\nmrca = a b\noutfile = treepl_ML.tre\nopt = 3\noptad = 2\nsmooth = 1\n"
    for bad in (lambda c, n: "", lambda c, n: "opt = 1"):
        with pytest.raises(ValueError):
            dating.date_tree(bad, "", "t", "x", 1)
    reps = spark.createDataFrame([(k, "(a:1,b:2);" if k != 2 else "(a") for k in range(5)], "tree_no int, newick string")
    got = dating.date_replicates(reps, lambda c, n: c.split("\n")[0], "numsites = 9", ["opt = 3"], 1.0).collect()
    assert {r.tree_no: r.status[:5] for r in got} == {0: "OK", 1: "OK", 2: "ERROR", 3: "OK", 4: "OK"}
    assert {r.dated for r in got if r.status == "OK"} == {"treefile = (a:100.0,b:200.0);"}
    drawn = [tuple(sorted(r.tree_no for r in dating.date_replicates(reps, lambda c, n: "", "", [], 1.0, n=2, seed=s).collect())) for s in range(8)]
    assert all(len(x) == 2 for x in drawn) and len(set(drawn)) > 2


def test_bootstrap_draws_with_replacement(spark):
    aln = spark.createDataFrame([("m", "a", 1, "ACGT" * 250), ("m", "b", 2, "TGCA" * 250), ("n", None, 1, "ACGTA"), ("n", None, 1, "AC"), ("e", "z", 1, "")], SEQS)
    draws = {(r.marker, r.replicate): r.columns for r in sites.bootstrap_columns(aln, 40).collect()}
    share = [len(set(c)) / len(c) for (m, _), c in draws.items() if m == "m"]
    assert all(len(c) == 1000 and 1 <= min(c) and max(c) <= 1000 for (m, _), c in draws.items() if m == "m")
    assert 0.61 < sum(share) / len(share) < 0.655  # 1 - 1/e
    assert len({tuple(c) for (m, _), c in draws.items() if m == "m"}) == 40
    assert sites.bootstrap_columns(aln, 1, seed=5).where("marker = 'm'").first().columns != draws["m", 1]
    rows = sites.resample_columns(aln, 2).collect()
    assert len(rows) == 8
    both = {r.name: r.seq for r in rows if r.marker == "m" and r.replicate == 2}
    assert both["b"] == both["a"].translate(str.maketrans("ACGT", "TGCA"))  # sequences of a marker share the draws


def test_guards(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "Genus int")
    with pytest.raises(ValueError, match="Specie_name, Clade"):
        guards.require_constraint_columns(df)
    assert guards.require_columns(df, ["Genus"]) is df
    assert guards.require_path(spark, str(tmp_path), folder=True) == str(tmp_path)
    for path, folder in ((f"{tmp_path}/none", None), (str(tmp_path), False)):
        with pytest.raises(FileNotFoundError):
            guards.require_path(spark, path, folder)
    with pytest.raises(FileNotFoundError):
        guards.require_program("no-such-program-here")
    log = guards.RunLog()
    log.write("read ", 3, " files")
    log.save(spark, f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").first()[0].endswith("] read 3 files")


def test_tolerant_fasta_reading(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x\nAC\nGT\n>y\nTT\n")
    (tmp_path / "b.fasta").write_text("not a sequence\n>z\nAA\n")
    (tmp_path / "c.fasta").write_text("")
    rows, status = formats.read_fasta_safe(spark, str(tmp_path))
    assert {(r.marker, r.name, r.seq) for r in rows.collect()} == {("a", "x", "ACGT"), ("a", "y", "TT")}
    assert {(r.file.rsplit("/", 1)[1], r.n_records, r.status) for r in status.collect()} == {("a.fasta", 2, "OK"), ("b.fasta", 0, "NOT_FASTA"), ("c.fasta", 0, "EMPTY")}


def test_tables_workbooks_and_double_names(spark, tmp_path):
    (tmp_path / "t.txt").write_text('markers  value\n"trnS(GCU) x"   1\n  matK\n\n')
    assert [tuple(r) for r in formats.read_table(spark, f"{tmp_path}/t.txt", ["markers", "value"]).collect()] == [("trnS(GCU) x", "1"), ("matK", None)]
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>Opun</t></r><r><t>tia</t></r></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>4.5</v></c></row><row><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
    sheet = formats.read_excel(spark, f"{tmp_path}/b.xlsx")
    assert sheet.columns == ["name", "column_2", "n"] and [tuple(r) for r in sheet.collect()] == [("Opuntia", None, "4.5"), (None, None, "7")]
    formats.write_csv_dual(spark.createDataFrame([("a", None)], "x string, y string"), f"{tmp_path}/csv", "old.csv", "new.csv")
    for name in ("old.csv", "new.csv"):
        assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/csv/{name}", header=True).collect()] == [("a", None)]
        assert {r.value for r in spark.read.text(f"{tmp_path}/csv/{name}").collect()} == {"x,y", "a,"}


def test_comments_of_annotated_trees(spark):
    df = spark.createDataFrame([('&rate=1.5,height_95%_HPD={0.1,2.5},name="a b",rate=2',), ("plain",), (None,)], "comment string")
    got = [r[0] for r in df.select(formats.comment_values("comment")).collect()]
    assert got == [{"rate": "1.5", "height_95%_HPD": "{0.1,2.5}", "name": "a b"}, None, None]


def test_clade_labels_and_positions(spark):
    nodes = formats.newick_nodes(spark.createDataFrame([("t", "(((a:1,b:1):1,c:2):1,(d:1,e:1):3);")], "tree_id string, newick string"))
    at = {r.node_id: (r.x, r.y) for r in trees.node_positions(nodes).collect()}
    tips = {r.label: at[r.node_id] for r in nodes.where("is_tip").collect()}
    assert tips == {"a": (3.0, 1.0), "b": (3.0, 2.0), "c": (3.0, 3.0), "d": (4.0, 4.0), "e": (4.0, 5.0)} and at[0] == (0.0, (2.25 + 4.5) / 2)
    groups = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "d"), ("g2", "e"), ("g0", "d"), ("g0", "e")], "grp string, tip string")
    registry = trees.group_nodes(nodes, groups).withColumn("layer", F.lit("level_1"))
    got = [(r.ord, r.label, r.n_tips, r.y) for r in trees.clade_labels(nodes, registry, ["level_1"]).orderBy("ord").collect()]
    assert got == [(1, "g0", 2, 4.5), (2, "g1", 2, 1.5)]
    assert [r.label for r in trees.clade_labels(nodes, registry, ["level_1"], descending=False).orderBy("ord").collect()] == ["g1", "g0"]
    assert trees.clade_labels(nodes, registry, ["level_9"]).count() == 0


def test_fetchers(spark):
    text = '{"result": {"uids": ["1", "2"], "1": {"accessionversion": "AB1.1", "organism": "Opuntia x", "title": "t"}, "2": {"error": "gone"}}}'
    assert external.parse_summaries(text) == [("AB1.1", "Opuntia x", "t")] and "id=a%2Cb" in external.summary_url(["a", "b"])

    def fetch(name):
        if name == "b":
            raise OSError("down")
        return '{"assessments": []}'

    got = external.fetch_records(spark.createDataFrame([("a",), ("b",), ("a",)], "species_clean string"), fetch, pause=0.0).collect()
    assert {(r.species_clean, r.json) for r in got} == {("a", '{"assessments": []}'), ("b", None)}


def test_commands_of_external_programs():
    assert external.mafft("in.fa", "--auto --quiet") == ["mafft", "--auto", "--quiet", "in.fa"]
    assert external.raxml_check("a", "m", "p")[1] == "--check" and external.raxml_rf("t", "p")[1:] == ["--rfdist", "--tree", "t", "--prefix", "p"]
    search = external.raxml_search("a.phy", "p.txt", "out", constraint="c.tre", outgroup="Out_x", workers=2)
    assert search == ["raxml-ng", "--search", *"--msa a.phy --model p.txt --tree-constraint c.tre --tree rand{25},pars{25} --seed 111 --workers 2 --threads 4 --prefix out --outgroup Out_x".split()]
    boot = external.raxml_bootstrap("a", "m", "o", trees=7)
    assert boot == ["raxml-ng", "--bootstrap", *"--msa a --model m --bs-trees 7 --bs-metric tbe --seed 111 --threads 4 --prefix o".split()]
    assert external.raxml_converged("b", "o")[2:6] == ["--bs-trees", "b", "--bs-metric", "tbe"]
    assert external.treepl("c") == ["treePL", "c"] and external.astral("j", "g", "o")[:3] == ["java", "-jar", "j"] and "ml" in external.modeltest("a", "p", "o")


def test_files_round_trip(spark, tmp_path):
    aln = spark.createDataFrame([("m1", "a", 1, "AC"), ("m1", "b", 2, "GT"), ("m2", "a", 3, "TT")], SEQS)
    formats.write_fasta(aln, f"{tmp_path}/fa")
    assert {(r.name, r.seq) for r in formats.read_fasta(spark, f"{tmp_path}/fa").collect()} == {("a", "AC"), ("b", "GT"), ("a", "TT")}
    (tmp_path / "map.csv").write_text('search,replace\n"a, b", first\n c ,"x ""y"""\n')
    assert [tuple(r) for r in formats.read_delimited(spark, f"{tmp_path}/map.csv", "search string, replace string").collect()] == [("a, b", "first"), ("c", 'x "y"')]
    (tmp_path / "reps").mkdir()
    (tmp_path / "reps" / "rep_1.raxml.bootstraps").write_text("(a,b);\n(a,(b,c));\n")
    (tmp_path / "reps" / "rep_1.raxml.log").write_text("(not,a,tree);\n")
    assert sorted(r.newick for r in formats.collect_bootstraps(spark, f"{tmp_path}/reps").collect()) == ["(a,(b,c));", "(a,b);"]


def test_calibration_file(spark):
    cal = spark.createDataFrame([("N1", "clade", "X", 1.0, 2.5, True), ("N2", "clade", "Y", 1.0, 2.0, True), ("N3", "clade", "X", 0.0, 9.0, False)], "mrca string, `column` string, `value` string, `min` double, `max` double, used_in_analysis boolean")
    taxonomy = spark.createDataFrame([("b", "X"), ("a", "X"), ("c", "Y"), ("d", "Y")], "taxon string, clade string")
    lines = dating.calibration_lines(cal, taxonomy, spark.createDataFrame([("a",), ("b",), ("c",)], "taxon string"), ["clade"])
    assert dating.calibration_config(lines, 100, 8) == "numsites = 100\nmrca = N1 a b\nmin = N1 1.000000\nmax = N1 2.500000\nnthreads = 8\nthorough\n"


def test_compacted_cache_goes_on(spark, tmp_path):
    schema = "sid string, v int"
    spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], schema).write.parquet(f"{tmp_path}/in")
    cache.grow_cache(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", f"{tmp_path}/k").awaitTermination()
    assert {(r.sid, r.v) for r in cache.read_cache(spark, f"{tmp_path}/c").collect()} == {("a", 1), ("b", 1)}
    cache.compact_cache(spark, f"{tmp_path}/c", f"{tmp_path}/d")
    spark.createDataFrame([("a", 0), ("c", 5)], schema).write.mode("overwrite").parquet(f"{tmp_path}/in")
    cache.grow_cache(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/d", f"{tmp_path}/k2").awaitTermination()
    assert {(r.sid, r.v) for r in cache.read_cache(spark, f"{tmp_path}/d").collect()} == {("a", 1), ("b", 1), ("c", 5)}
