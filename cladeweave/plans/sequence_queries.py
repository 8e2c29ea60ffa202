"""Queries of names, alignments, distances and concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeweave.functions import names
from cladeweave.operators import concatenation, curation, distances, patterns, registry, sites
from cladeweave.operators.lineage import cut
from cladeweave.plans.catalogue import PLACES, register
from cladeweave.sources.adapters import SITES, canonical

MARKERS = [f"src{k}" for k in range(20)]  # the columns of the SQL; the engine takes them from the table
ALN = "alignment"


def _markers(rows):
    """All markers of a table in order; there is one column for each, so they are few."""
    return [r[0] for r in rows.select("marker").distinct().orderBy(F.length("marker"), "marker").collect()]


def _aln(s, d):
    return canonical(s, d, "alignment")


_SITE = f"site AS (SELECT marker, ord, pos, substr(seq, pos, 1) AS base FROM alignment, (SELECT unnest(range(1, {SITES + 1})) AS pos) p)"
_STATE = f"WITH {_SITE}, st AS (SELECT marker, pos, base, count(*) AS n FROM site GROUP BY marker, pos, base)"
_ACGT = "base IN ('A', 'C', 'G', 'T')"
_OPEN = "base NOT IN ('-', 'N')"
_SCREEN = (
    f"{_STATE}, by_pos AS (SELECT marker, pos, count(*) FILTER (WHERE {_ACGT}) AS states, count(*) FILTER (WHERE {_ACGT} AND n >= 2) AS twice, sum(n) AS cells, coalesce(sum(n) FILTER (WHERE {_ACGT}), 0) AS acgt, "
    "coalesce(sum(n) FILTER (WHERE base IN ('G', 'C')), 0) AS gc FROM st GROUP BY marker, pos), "
    f"ent AS (SELECT marker, pos, -sum(n * ln(n / t::DOUBLE)) / any_value(t) AS e FROM (SELECT marker, pos, n, sum(n) OVER (PARTITION BY marker, pos) AS t FROM st WHERE {_ACGT}) GROUP BY marker, pos), "
    "screen AS (SELECT marker, count(*) AS total_cols, count(*) FILTER (WHERE states > 0) AS aln_len, 1 - sum(acgt) / sum(cells)::DOUBLE AS missing, 1 - sum(acgt) / sum(cells)::DOUBLE AS gaps, sum(gc) / nullif(sum(acgt), 0)::DOUBLE AS gc, "
    "count(*) FILTER (WHERE states > 1) AS var_sites, count(*) FILTER (WHERE states > 1 AND twice >= 1) AS pi_sites FROM by_pos GROUP BY marker)"
)
_CONCAT = (
    "count(*) AS {0}, round(100::DOUBLE * sum(ns) / sum(cells), 3) AS missing_pct, round(100::DOUBLE * sum(gap) / sum(cells), 3) AS gaps_pct, round(100::DOUBLE * sum(gc) / nullif(sum(acgt), 0), 3) AS gc_pct, "
    "count(*) FILTER (WHERE states > 1) AS variable_sites, count(*) FILTER (WHERE twice >= 2) AS parsimony_informative, count(*) FILTER (WHERE states = 1) AS invariant_sites"
)
_BYPOS2 = (
    f"{_STATE}, by_pos AS (SELECT marker, pos, count(*) FILTER (WHERE {_OPEN}) AS states, count(*) FILTER (WHERE {_OPEN} AND n >= 2) AS twice, sum(n) AS cells, coalesce(sum(n) FILTER (WHERE base = 'N'), 0) AS ns, coalesce(sum(n) FILTER (WHERE base = '-'), 0) AS gap, "
    f"coalesce(sum(n) FILTER (WHERE {_ACGT}), 0) AS acgt, coalesce(sum(n) FILTER (WHERE base IN ('G', 'C')), 0) AS gc FROM st GROUP BY marker, pos)"
)
register(
    "screen_site_stats", lambda s, d: sites.screening_stats(_aln(s, d)).drop("entropy"), f"{_SCREEN} SELECT * FROM screen", ALN, "missing gaps gc",
)
register("screen_entropy", lambda s, d: sites.screening_stats(_aln(s, d)).select("marker", "entropy"), f"{_SCREEN} SELECT marker, avg(e) AS entropy FROM ent GROUP BY marker", ALN, "entropy")
register(
    "marker_statistics", lambda s, d: sites.marker_stats(_aln(s, d)),
    f"{_BYPOS2} SELECT b.marker, {_CONCAT.format('alignment_length')}, any_value(t.n) AS n_taxa FROM by_pos b JOIN (SELECT marker, count(*) AS n FROM alignment GROUP BY marker) t ON b.marker = t.marker GROUP BY b.marker", ALN, "missing_pct gaps_pct gc_pct",
)
register(
    "supermatrix_statistics", lambda s, d: sites.supermatrix_stats(_aln(s, d)),
    f"{_BYPOS2}, grid AS (SELECT b.states, b.twice, b.ns, b.gap + t.n - b.cells AS gap, t.n AS cells, b.acgt, b.gc, t.n FROM by_pos b, (SELECT count(DISTINCT name) AS n FROM alignment) t) SELECT n AS n_taxa, {_CONCAT.format('total_alignment_length')} FROM grid GROUP BY n", ALN, "missing_pct gaps_pct gc_pct",
)
_LEN = "length(seq)"
_STAGE = (
    "count(*) AS n_sequences, min(length(seq)) AS min_sequence_length, max(length(seq)) AS max_sequence_length, avg(length(seq)) AS mean_sequence_length, "
    "avg((length(seq) - length(replace(seq, 'N', ''))) / nullif(length(seq), 0)::DOUBLE) AS mean_fraction_missing, avg((length(seq) - length(replace(seq, '-', ''))) / nullif(length(seq), 0)::DOUBLE) AS mean_fraction_gaps"
)
register("alignment_stage_stats", lambda s, d: sites.stage_stats(_aln(s, d)), f"SELECT marker, {_STAGE} FROM alignment GROUP BY marker", ALN, "mean_sequence_length mean_fraction_missing mean_fraction_gaps")
_GAPLESS = f"{_STATE}, held AS (SELECT DISTINCT marker, pos FROM st WHERE base <> '-'), common AS (SELECT s.marker, a.name, s.ord, string_agg(base, '' ORDER BY s.pos) AS seq FROM site s JOIN held h ON s.marker = h.marker AND s.pos = h.pos JOIN alignment a ON s.marker = a.marker AND s.ord = a.ord GROUP BY s.marker, a.name, s.ord)"
register("common_gap_removed", lambda s, d: sites.drop_common_gaps(_aln(s, d)), f"{_GAPLESS} SELECT * FROM common", ALN)
_FILTERED = (
    "{0}, logged AS (SELECT *, non_gap_sites_after_masking < w * 0.965::DOUBLE AS removed_low_coverage, coalesce(fraction_missing_after_masking > 0.02, true) AS removed_high_missingness FROM (SELECT a.*, length(replace(seq, '-', '')) AS non_gap_sites_after_masking, "
    "(length(seq) - length(replace(seq, 'N', ''))) / nullif(length(seq), 0)::DOUBLE AS fraction_missing_after_masking, max(length(seq)) OVER (PARTITION BY marker) AS w FROM common a)), flog AS (SELECT * EXCLUDE (w), removed_low_coverage OR removed_high_missingness AS removed_final FROM logged)"
).format(_GAPLESS)


def _filtered(s, d):
    return sites.filter_sequences(sites.drop_common_gaps(_aln(s, d)), 0.965, 0.02)


register("sequence_filter_log", _filtered, f"{_FILTERED} SELECT * FROM flog", ALN, "fraction_missing_after_masking")


def _manifest(s, d):
    aln = _aln(s, d)
    common, log = sites.drop_common_gaps(aln), _filtered(s, d)
    steps = {"raw_input": aln.withColumn("seq", F.replace("seq", F.lit("-"), F.lit(""))), "mafft_aligned": aln, "common_gap_removed": common, "masked_alignment": common, "final_filtered": log.where("NOT removed_final")}
    out = None
    for stage, rows in steps.items():
        stats = sites.stage_stats(rows).withColumn("stage", F.lit(stage))
        out = stats if out is None else out.unionByName(stats)
    return sites.manifest(out, log)


_S = sites.STAGES
_WIDE = ", ".join(f"max({c}) FILTER (WHERE stage = '{s}') AS {n}_{s}" for n, c in {"n_sequences": "n_sequences", "alignment_length": "max_sequence_length", "mean_fraction_missing": "mean_fraction_missing", "mean_fraction_gaps": "mean_fraction_gaps"}.items() for s in _S)
_N, _W = (lambda k: f"n_sequences_{_S[k]}"), (lambda k: f"alignment_length_{_S[k]}")
_SHARE = lambda a, b: f"CAST({a} AS DOUBLE) / CASE WHEN {b} > 0 THEN {b} END"
register(
    "alignment_manifest", _manifest,
    f"""{_FILTERED}, stages AS (SELECT 'raw_input' AS stage, marker, {_STAGE} FROM (SELECT marker, replace(seq, '-', '') AS seq FROM alignment) GROUP BY marker UNION ALL SELECT 'mafft_aligned', marker, {_STAGE} FROM alignment GROUP BY marker
    UNION ALL SELECT 'common_gap_removed', marker, {_STAGE} FROM common GROUP BY marker UNION ALL SELECT 'masked_alignment', marker, {_STAGE} FROM common GROUP BY marker UNION ALL SELECT 'final_filtered', marker, {_STAGE} FROM flog WHERE NOT removed_final GROUP BY marker),
    wide AS (SELECT marker, {_WIDE} FROM stages GROUP BY marker), l AS (SELECT marker, count(*) FILTER (WHERE removed_low_coverage) AS low, count(*) FILTER (WHERE removed_high_missingness) AS high, count(*) FILTER (WHERE removed_final) AS fin FROM flog GROUP BY marker)
    SELECT wide.*, {_N(0)} - {_N(4)} AS n_sequences_removed_total, coalesce(low, 0) AS n_sequences_removed_low_coverage, coalesce(high, 0) AS n_sequences_removed_high_missingness, coalesce(fin, 0) AS n_sequences_removed_by_filtering,
    {_W(1)} - {_W(2)} AS n_sites_removed_by_common_gap_removal, {_W(2)} - {_W(3)} AS n_sites_removed_by_masking, {_W(1)} - {_W(4)} AS n_sites_removed_total_from_mafft,
    {_SHARE(_N(1), _N(0))} AS pct_sequences_retained_after_mafft, {_SHARE(_N(2), _N(0))} AS pct_sequences_retained_after_common_gap_removal, {_SHARE(_N(3), _N(0))} AS pct_sequences_retained_after_masking, {_SHARE(_N(4), _N(0))} AS pct_sequences_retained_final,
    {_SHARE(_W(2), _W(1))} AS pct_sites_retained_after_common_gap_removal, {_SHARE(_W(3), _W(1))} AS pct_sites_retained_after_masking, {_SHARE(_W(4), _W(1))} AS pct_sites_retained_final_vs_mafft,
    {_N(3)} IS NOT NULL AS masking_applied, coalesce({_N(4)}, 0) > 0 AS final_alignment_written, CASE WHEN coalesce({_N(4)}, 0) = 0 THEN 'ZERO_RETAINED' WHEN {_N(3)} IS NULL THEN 'OK_NO_MASK' ELSE 'OK' END AS status FROM wide LEFT JOIN l ON wide.marker = l.marker""",
    ALN,
    " ".join(f"mean_fraction_{n}_{s}" for n in ("missing", "gaps") for s in _S) + " pct_sequences_retained_after_mafft pct_sequences_retained_after_common_gap_removal pct_sequences_retained_after_masking pct_sequences_retained_final pct_sites_retained_after_common_gap_removal pct_sites_retained_after_masking pct_sites_retained_final_vs_mafft",
)
_INFORMATION = "2 - (ln(valid) - nlogn / valid) / ln(2.0::DOUBLE) - 3 / (2 * ln(2.0::DOUBLE) * valid)"
register(
    "masked_columns", lambda s, d: sites.mask_columns(_aln(s, d)),
    f"""{_STATE}, cols AS (SELECT marker, pos, sum(n) AS cells, coalesce(sum(n) FILTER (WHERE base = '-'), 0) AS gaps, sum(n) FILTER (WHERE {_ACGT}) AS valid, sum(n * ln(n)) FILTER (WHERE {_ACGT}) AS nlogn FROM st GROUP BY marker, pos),
    held AS (SELECT marker, pos FROM cols WHERE gaps / cells::DOUBLE <= 0.8 AND valid > 0 AND {_INFORMATION} >= 0.2)
    SELECT a.marker, a.name, a.ord, coalesce(x.seq, '') AS seq FROM alignment a LEFT JOIN (SELECT s.marker, s.ord, string_agg(base, '' ORDER BY s.pos) AS seq FROM site s JOIN held h ON s.marker = h.marker AND s.pos = h.pos GROUP BY s.marker, s.ord) x ON a.marker = x.marker AND a.ord = x.ord""", ALN,
)
register(
    "taxon_reconcile", lambda s, d: curation.reconcile_taxa(_aln(s, d), "name", _aln(s, d).where("marker = 'src3'").select(F.replace("name", F.lit("_"), F.lit(" ")).alias("pureName")), "pureName").select("marker", "name", "ord"),
    "SELECT marker, name, ord FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS r FROM alignment WHERE name IN (SELECT name FROM alignment WHERE marker = 'src3')) WHERE r = 1", ALN,
)
# Draws are with replacement: their definition is the MD5 of the seed, the replicate, the marker and the place.
# Means over neighbours in a bounded frame; runs of conserved columns by place less rank.
_CONSERVED = (
    f"{_STATE}, ent AS (SELECT marker, pos, sum(n) FILTER (WHERE {_ACGT}) AS t, sum(n * ln(n)) FILTER (WHERE {_ACGT}) AS nl, coalesce(sum(n) FILTER (WHERE base = '-'), 0) / sum(n)::DOUBLE AS share FROM st GROUP BY marker, pos), "
    "info AS (SELECT marker, pos, share, CASE WHEN t > 0 THEN greatest(0, 2 - (ln(t) - nl / t) / ln(2) - 3 / (2 * ln(2) * t)) ELSE 0 END AS bits FROM ent), "
    "near AS (SELECT marker, pos, bits, avg(bits) OVER w AS b, avg(share) OVER w AS g FROM info WINDOW w AS (PARTITION BY marker ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), "
    "runs AS (SELECT *, pos - row_number() OVER (PARTITION BY marker ORDER BY pos) AS island FROM near WHERE b >= 0.9::DOUBLE AND g <= 0.06::DOUBLE), "
    "stretches AS (SELECT marker, min(pos) AS first, max(pos) AS last, count(*) AS n_sites, avg(bits) AS mean_information FROM runs GROUP BY marker, island HAVING count(*) >= 5)"
)
_RULE = {"reach": 3, "min_information": 0.9, "max_gaps": 0.06, "min_length": 5}
register(
    "conserved_stretches", lambda s, d: sites.conserved_stretches(_aln(s, d), **_RULE),
    f"{_CONSERVED} SELECT marker, CAST(row_number() OVER (PARTITION BY marker ORDER BY first) AS INTEGER) AS stretch, first, last, n_sites, mean_information FROM stretches", ALN, "mean_information",
)
register(
    "masked_to_stretches", lambda s, d: sites.mask_to_stretches(_aln(s, d), **_RULE).select("marker", "ord", "seq"),
    f"{_CONSERVED} SELECT a.marker, a.ord, coalesce(string_agg(s.base, '' ORDER BY s.pos) FILTER (WHERE t.marker IS NOT NULL), '') AS seq FROM alignment a JOIN site s ON a.marker = s.marker AND a.ord = s.ord LEFT JOIN stretches t ON t.marker = s.marker AND s.pos BETWEEN t.first AND t.last GROUP BY a.marker, a.ord", ALN,
)
# Sequences as long as their texts, in both cases, with letters of all kinds; columns beyond a sequence's end have no cell.
register(
    "ragged_statistics", lambda s, d: sites.marker_stats(canonical(s, d, "ragged")),
    f"""WITH st AS (SELECT marker, pos, base, count(*) AS n FROM (SELECT marker, unnest(string_split(upper(seq), '')) AS base, unnest(range(1, length(seq) + 1)) AS pos FROM ragged WHERE length(seq) > 0) GROUP BY marker, pos, base)
    {_BYPOS2[_BYPOS2.index(', by_pos'):]} SELECT b.marker, {_CONCAT.format('alignment_length')}, any_value(t.n) AS n_taxa FROM by_pos b JOIN (SELECT marker, count(*) AS n FROM ragged GROUP BY marker) t ON b.marker = t.marker GROUP BY b.marker""", "ragged", "missing_pct gaps_pct gc_pct",
)
register(
    "bootstrap_resample", lambda s, d: sites.resample_columns(_aln(s, d), 3).select("replicate", "marker", "name", "seq"),
    f"""WITH drawn AS (SELECT marker, CAST(r AS INT) AS replicate, list_transform(range(1, {SITES + 1}), lambda k: CAST(('0x' || substr(md5('111:' || r || ':' || marker || ':' || k), 1, 15))::BIGINT % {SITES} + 1 AS INT)) AS at FROM (SELECT DISTINCT marker FROM alignment), range(1, 4) t(r))
    SELECT d.replicate, a.marker, a.name, array_to_string(list_transform(d.at, lambda p: substr(a.seq, p, 1)), '') AS seq FROM alignment a JOIN drawn d ON a.marker = d.marker""", ALN,
)

_PAIR = (
    f"WITH {_SITE}, v AS (SELECT *, CASE WHEN base IN ('A', 'G') THEN 1 ELSE 0 END AS pur FROM site WHERE {_ACGT}), "
    "pc AS (SELECT a.marker, a.ord AS ord_i, b.ord AS ord_j, count(*) AS n, count(*) FILTER (WHERE a.base <> b.base AND a.pur = b.pur) AS ts, count(*) FILTER (WHERE a.pur <> b.pur) AS tv FROM v a JOIN v b ON a.marker = b.marker AND a.pos = b.pos AND a.ord < b.ord GROUP BY 1, 2, 3), "
    "pq AS (SELECT marker, ord_i, ord_j, ts / n::DOUBLE AS p, tv / n::DOUBLE AS q FROM pc), dist AS (SELECT marker, ord_i, ord_j, CASE WHEN 1 - 2 * p - q > 0 AND 1 - 2 * q > 0 THEN -0.5 * ln(1 - 2 * p - q) - 0.25 * ln(1 - 2 * q) END AS k80, "
    "CASE WHEN 1 - 2 * p - q > 0 AND 1 - 2 * q > 0 THEN 0.5 * (1 / (1 - 2 * p - q) + 0.5 / (1 - 2 * q) - 1.5) END AS k80_gamma, CASE WHEN 1 - 4 * (p + q) / 3 > 0 THEN -0.75 * ln(1 - 4 * (p + q) / 3) END AS jc69 FROM pq)"
)
# Replicates from weights of distinct columns; the SQL repeats every column as often as it is drawn.
_DRAWS = f"draws AS (SELECT marker, r AS replicate, k, CAST(('0x' || substr(md5('111:' || r || ':' || marker || ':' || k), 1, 15))::BIGINT % {SITES} + 1 AS INT) AS p FROM (SELECT DISTINCT marker FROM alignment), range(1, {{0}}) t(r), range(1, {SITES + 1}) u(k))"


def _replicates(s, d, n):
    aln = _aln(s, d)
    found = cut(patterns.site_patterns(aln))
    return aln, found, cut(patterns.replicate_weights(aln, found, n))


register(
    "replicate_weights", lambda s, d: _replicates(s, d, 5)[2],
    f"WITH {_SITE}, columns_ AS (SELECT marker, pos, string_agg(base, '' ORDER BY ord) AS c FROM site GROUP BY marker, pos), firsts AS (SELECT marker, pos, min(pos) OVER (PARTITION BY marker, c) AS pattern FROM columns_), {_DRAWS.format(6)} "
    "SELECT d.marker, CAST(d.replicate AS INTEGER) AS replicate, CAST(f.pattern AS INTEGER) AS pattern, count(*) AS weight FROM draws d JOIN firsts f ON d.marker = f.marker AND d.p = f.pos GROUP BY 1, 2, 3", ALN,
)


def _replicate_statistics(s, d):
    aln, _, weights = _replicates(s, d, 20)
    return patterns.replicate_statistics(aln, weights)


register(
    "replicate_statistics", _replicate_statistics,
    f"{_BYPOS2}, {_DRAWS.format(21)} SELECT b.marker, CAST(d.replicate AS INTEGER) AS replicate, {_CONCAT.format('alignment_length')}, any_value(t.n) AS n_taxa FROM by_pos b JOIN draws d ON b.marker = d.marker AND b.pos = d.p JOIN (SELECT marker, count(*) AS n FROM alignment GROUP BY marker) t ON b.marker = t.marker GROUP BY 1, 2",
    ALN, "missing_pct gaps_pct gc_pct",
)


def _replicate_k80(s, d):
    aln, found, weights = _replicates(s, d, 2)
    pairs = patterns.replicate_pair_distances(aln, found, weights, "k80", places=PLACES)
    return pairs.withColumn("replicate", F.col("replicate").cast("int"))


register(
    "replicate_k80", _replicate_k80,
    _PAIR.replace(_SITE, f"{_DRAWS.format(3)}, site AS (SELECT a.marker || '|' || d.replicate AS marker, a.ord, d.k AS pos, substr(a.seq, d.p, 1) AS base FROM alignment a JOIN draws d ON a.marker = d.marker)")
    + " SELECT split_part(marker, '|', 1) AS marker, CAST(split_part(marker, '|', 2) AS INTEGER) AS replicate, ord_i, ord_j, k80 FROM dist", ALN, "k80", is_rounded=True,
)
_OUT = (
    f"{_PAIR}, both_ways AS (SELECT marker, ord_i AS ord, jc69 FROM dist UNION ALL SELECT marker, ord_j, jc69 FROM dist), md AS (SELECT marker, ord, sum(jc69) / (count(jc69) + 1) AS mean_dist FROM both_ways GROUP BY marker, ord), "
    "fence AS (SELECT marker, quantile_cont(mean_dist, 0.75) + 1.5 * (quantile_cont(mean_dist, 0.75) - quantile_cont(mean_dist, 0.25)) AS upper_cut FROM md GROUP BY marker)"
)
_SLOPE = (
    "slope AS (SELECT marker, n_pairs, CASE WHEN n_pairs >= 5 AND v > 0 THEN s END AS slope, CASE WHEN n_pairs >= 5 AND v > 0 THEN s < 0.3 END AS saturated, CASE WHEN n_pairs < 5 THEN 'insufficient_data' WHEN NOT v > 0 THEN 'regression_failed' ELSE 'ok' END AS reason "
    "FROM (SELECT marker, count(k80) AS n_pairs, regr_slope(k80_gamma, k80) AS s, var_samp(k80) AS v FROM dist GROUP BY marker))"
)


for _name in ("k80", "k80_gamma", "jc69"):
    register(f"pair_{_name}", lambda s, d, n=_name: distances.pair_distances(_aln(s, d), n, places=PLACES), f"{_PAIR} SELECT marker, ord_i, ord_j, {_name} FROM dist", ALN, _name, is_rounded=True)
register(
    "outliers_iqr", lambda s, d: distances.outliers_of_sums(_aln(s, d), distances.pair_sums(_aln(s, d), moments=False)),
    f"{_OUT} SELECT a.marker, a.ord, a.name, md.mean_dist, f.upper_cut, md.mean_dist > f.upper_cut AS is_outlier FROM alignment a JOIN md ON a.marker = md.marker AND a.ord = md.ord JOIN fence f ON a.marker = f.marker", ALN, "mean_dist upper_cut",
)


def _slopes(s, d):
    return distances.saturation_of_sums(_aln(s, d), cut(distances.pair_sums(_aln(s, d), totals=False)))


register("saturation_slope", _slopes, f"{_PAIR}, {_SLOPE} SELECT * FROM slope", ALN, "slope")
_REASONS = "concat_ws(';', CASE WHEN coalesce(saturated, false) THEN 'flagged_as_saturated' END, CASE WHEN slope IS NULL THEN 'slope_na' END, CASE WHEN slope <= 0.5 THEN 'slope_le_0.5' END, CASE WHEN missing >= 0.7 THEN 'missing_ge_0.7' END, CASE WHEN var_sites <= 0 THEN 'no_variable_sites' END, CASE WHEN aln_len < 200 THEN 'aln_len_lt_200' END, CASE WHEN n < 100 THEN 'nseq_lt_100' END)"
register(
    "marker_decision", lambda s, d: distances.decide(sites.screening_stats(_aln(s, d)), _slopes(s, d), _aln(s, d)),
    f"""{_SCREEN.replace(_SITE + ',', _PAIR[5:] + ',')}, {_SLOPE} SELECT marker, CASE WHEN total_cols < 50 THEN 'skipped_short_alignment' WHEN why = '' THEN 'processed_retained' ELSE 'processed_rejected' END AS status, CASE WHEN total_cols >= 50 AND why = '' THEN 'YES' ELSE 'NO' END AS decision,
    CASE WHEN total_cols < 50 THEN 'alignment_shorter_than_50_columns' WHEN why = '' THEN 'passed_all_thresholds' ELSE why END AS decision_reason, n AS n_sequences, aln_len, var_sites
    FROM (SELECT s.*, l.slope, l.saturated, t.n, {_REASONS} AS why FROM screen s LEFT JOIN slope l ON s.marker = l.marker LEFT JOIN (SELECT marker, count(*) AS n FROM alignment GROUP BY marker) t ON s.marker = t.marker)""", ALN,
)

_CLEAN = "regexp_replace(trim(regexp_replace(regexp_replace(lower(split_part(original_name, '|', 1)), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' ', '_', 'g')"
_CROSS = f"cross_names AS (SELECT marker, ord, original_name, upper(substr(c, 1, 1)) || substr(c, 2) AS cleaned_name FROM (SELECT *, {_CLEAN} AS c FROM sequence_header))"
_SID = "CASE WHEN len(string_split(original_name, '|')) >= 2 THEN trim(string_split(original_name, '|')[-1]) WHEN len(string_split(trim(original_name), '_')) > 1 AND regexp_matches(string_split(trim(original_name), '_')[-1], '[0-9]') THEN string_split(trim(original_name), '_')[-1] ELSE '-' END"
register("name_crosswalk", lambda s, d: concatenation.name_crosswalk(canonical(s, d, "sequence_header")), f"WITH {_CROSS} SELECT marker, original_name, cleaned_name FROM cross_names", "sequence_header")
register("header_accessions", lambda s, d: canonical(s, d, "sequence_header").select("ord", names.header_accession("original_name").alias("sid")), f"SELECT ord, {_SID} AS sid FROM sequence_header", "sequence_header")


def _species_summary(s, d):
    rows = canonical(s, d, "sequence_header")
    rows = rows.select("marker", "ord", names.clean_taxon_name("original_name").alias("species"), names.header_accession("original_name").alias("sid"))
    markers = _markers(rows)
    return concatenation.occupancy(rows, len(markers)).join(concatenation.occupancy_matrix(rows, markers), "species")


def _heatmap(s, d):
    rows = _aln(s, d).select(F.col("name").alias("species"), "marker", "ord", F.concat(F.lit("S"), "ord").alias("sid"))
    markers = _markers(rows)
    return registry.marker_presence(concatenation.occupancy_matrix(rows, markers), markers)


register(
    "species_alignment_summary", _species_summary,
    f"WITH {_CROSS}, h AS (SELECT c.marker, c.ord, c.cleaned_name AS species, {_SID} AS sid FROM cross_names c) SELECT species, count(*) AS retained_markers, round(100::DOUBLE * count(*) / 20, 2) AS pct_markers, "
    + ", ".join(f"coalesce(arg_min(sid, ord) FILTER (WHERE marker = '{m}'), '-') AS {m}" for m in MARKERS) + " FROM h GROUP BY species", "sequence_header",
)
_RANGES = "sizes AS (SELECT marker, CAST(max(length(seq)) AS BIGINT) AS w FROM alignment GROUP BY marker), ranges AS (SELECT marker, CAST(sum(w) OVER (ORDER BY lower(marker), marker) AS BIGINT) - w + 1 AS start, CAST(sum(w) OVER (ORDER BY lower(marker), marker) AS BIGINT) AS \"end\" FROM sizes)"


def _ranges(s, d):
    return concatenation.marker_ranges(_aln(s, d))


register("marker_ranges", _ranges, f"WITH {_RANGES} SELECT * FROM ranges", ALN)
register("supermatrix_structure", lambda s, d: _ranges(s, d).withColumn("length", F.col("end") - F.col("start") + 1), f'WITH {_RANGES} SELECT *, "end" - start + 1 AS length FROM ranges', ALN)
register(
    "supermatrix_rows", lambda s, d: concatenation.supermatrix(_aln(s, d), _ranges(s, d)),
    f"""WITH {_RANGES}, grid AS (SELECT t.name, r.* FROM (SELECT DISTINCT name FROM alignment) t, ranges r) SELECT g.name, string_agg(rpad(coalesce(a.seq, ''), CAST(g."end" - g.start + 1 AS INT), '-'), '' ORDER BY g.start) AS seq
    FROM grid g LEFT JOIN (SELECT marker, name, arg_min(seq, ord) AS seq FROM alignment GROUP BY marker, name) a ON g.marker = a.marker AND g.name = a.name GROUP BY g.name""", ALN,
)
_LINES = " UNION ALL ".join(
    f"SELECT '{n}' AS format, marker, start, {e} AS line FROM ranges"
    for n, e in {
        "raxml": "'DNA, ' || marker || ' = ' || start || '-' || \"end\"", "iqtree": "'DNA, ' || marker || ' = ' || start || '-' || \"end\"",
        "partitionfinder": "marker || ' = ' || start || '-' || \"end\" || ';'", "mrbayes": "'   charset ' || marker || ' = ' || start || '-' || \"end\" || ';'",
    }.items()
)
register("partition_lines", lambda s, d: concatenation.partition_lines(_ranges(s, d)), f"WITH {_RANGES} {_LINES}", ALN)
register(
    "partition_clean", lambda s, d: concatenation.clean_partition(_ranges(s, d).select("marker", F.concat(F.lit("GTR+G, "), "marker", F.lit(" = 1-2")).alias("line"))),
    f"WITH {_RANGES} SELECT marker, 'DNA, ' || marker || ' = 1-2' AS line FROM ranges", ALN,
)
register("marker_coverage", lambda s, d: sites.marker_stats(_aln(s, d)).select("marker", "n_taxa"), "SELECT marker, count(*) AS n_taxa FROM alignment GROUP BY marker", ALN)
register(
    "informativeness", lambda s, d: sites.marker_stats(_aln(s, d)).select("marker", "alignment_length", "parsimony_informative"),
    f"{_BYPOS2} SELECT marker, count(*) AS alignment_length, count(*) FILTER (WHERE twice >= 2) AS parsimony_informative FROM by_pos GROUP BY marker", ALN,
)
register(
    "marker_completeness", lambda s, d: _aln(s, d).groupBy("name").agg(F.countDistinct("marker").alias("retained_markers")).groupBy("retained_markers").agg(F.count("*").alias("n_species")),
    "SELECT retained_markers, count(*) AS n_species FROM (SELECT name, count(DISTINCT marker) AS retained_markers FROM alignment GROUP BY name) GROUP BY retained_markers", ALN,
)
register(
    "presence_heatmap", _heatmap,
    "SELECT t.name AS species, m.marker, a.name IS NOT NULL AS present FROM (SELECT DISTINCT name FROM alignment) t, (SELECT 'src' || k AS marker FROM range(0, 20) r(k)) m LEFT JOIN (SELECT DISTINCT name, marker FROM alignment) a ON a.name = t.name AND a.marker = m.marker", ALN,
)
register(
    "marker_keys", lambda s, d: canonical(s, d, "file_name").select("doc_id", names.marker_key("path").alias("marker_key")),
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(string_split(path, '/')[-1], '\\.fasta$', ''), '^(ALN_masked_final_|MARKER_|Masked_)', ''), '[\\s/\\\\.\\-]+', '_', 'g') AS marker_key FROM file_name", "file_name",
)
register(
    "scalar_names", lambda s, d: canonical(s, d, "sequence_header").select("ord", names.clean_species_name("original_name").alias("clean"), names.header_species("original_name").alias("species"), names.first_binomial("original_name").alias("binomial"), names.clean_ambiguous("original_name").alias("bases"), names.standardize_taxon("original_name").alias("taxon")),
    """SELECT ord, trim(regexp_replace(replace(original_name, '.', ''), '\\s+', '_', 'g')) AS clean, regexp_replace(nullif(trim(split_part(original_name, '|', 1)), ''), '[ -]+', '_', 'g') AS species, regexp_replace(original_name, '^([^ ]+_[^ ]+).*', '\\1') AS binomial,
    regexp_replace(upper(original_name), '[^ACGT-]', 'N', 'g') AS bases, regexp_replace(regexp_replace(original_name, '[\\s_-]+', '_', 'g'), '^_|_$', '', 'g') AS taxon FROM sequence_header""", "sequence_header",
)
