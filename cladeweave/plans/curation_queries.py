"""Queries of cluster curation, integration, the registry and dating helpers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from cladeweave.functions import names
from cladeweave.operators import curation, dating, integration, registry
from cladeweave.operators.lineage import cut
from cladeweave.plans.catalogue import register
from cladeweave.sources.adapters import canonical

PREFERRED = "3"
MARKERS = ["the", "and", "that", "de", "la", "der"]
KEYS = [f"M{k}" for k in range(7)]
CLUSTERS = list(range(1, 8))


def _member(s, d):
    return canonical(s, d, "member")


def _removals(s, d, members=None):
    m = cut(_member(s, d)) if members is None else members  # read several times
    return curation.removals(m, curation.keep_preferred_parent(m, PREFERRED), canonical(s, d, "exclusion"))


def _clean(s, d):
    m = cut(_member(s, d))
    return curation.without(m, _removals(s, d, m)).select("cluster_id", "sid", "species", "parent")


def _cluster_counts(s, d):
    m = cut(_member(s, d))
    return curation.cluster_counts(m, cut(_removals(s, d, m)))


_DUP = "dup AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM member) WHERE n > 1)"
_KEEP = (
    f"WITH {_DUP}, keepers AS (SELECT DISTINCT cluster_id, sid FROM (SELECT *, max(CASE WHEN parent = '3' THEN 1 ELSE 0 END) OVER (PARTITION BY sid) AS p, min(cluster_id) OVER (PARTITION BY sid) AS c FROM dup) "
    "WHERE CASE WHEN p = 1 THEN parent = '3' ELSE cluster_id = c END)"
)
_GONE = (
    f"{_KEEP}, automatic AS (SELECT DISTINCT cluster_id, sid FROM dup WHERE (cluster_id, sid) NOT IN (SELECT (cluster_id, sid) FROM keepers)), "
    "gone AS (SELECT cluster_id, sid, arg_min(reason, o) AS reason FROM (SELECT cluster_id, sid, 'automatic duplicate resolution' AS reason, 0 AS o FROM automatic UNION ALL SELECT cluster_id, sid, reason, 1 FROM exclusion) GROUP BY ALL), "
    "clean AS (SELECT m.* FROM member m LEFT JOIN gone g ON m.cluster_id = g.cluster_id AND m.sid = g.sid WHERE g.sid IS NULL)"
).replace("GROUP BY ALL", "GROUP BY cluster_id, sid")

register(
    "sid_conflicts", lambda s, d: curation.accession_conflicts(_member(s, d)),
    """SELECT c.sid, c.n_clusters, c.clusters, p.species FROM
    (SELECT sid, count(*) AS n_clusters, string_agg(DISTINCT CAST(cluster_id AS STRING), ',' ORDER BY CAST(cluster_id AS STRING)) AS clusters FROM member GROUP BY sid HAVING count(*) > 1) c
    JOIN (SELECT sid, string_agg(species, ',' ORDER BY o) AS species FROM (SELECT sid, species, min(ord) AS o FROM member GROUP BY sid, species) GROUP BY sid) p ON c.sid = p.sid""", "member",
)
register("dup_keepers_ingroup", lambda s, d: curation.keep_preferred_parent(_member(s, d), PREFERRED), f"{_KEEP} SELECT cluster_id, sid FROM keepers", "member")
register(
    "dup_keepers_outgroup", lambda s, d: curation.keep_first_ranked(_member(s, d), PREFERRED),
    f"WITH {_DUP} SELECT cluster_id, sid FROM (SELECT cluster_id, sid, row_number() OVER (PARTITION BY sid ORDER BY CASE WHEN parent = '3' THEN 0 ELSE 1 END, cluster_id) AS r FROM dup) WHERE r = 1", "member",
)
register("rows_to_delete", _removals, f"{_GONE} SELECT cluster_id, sid, reason FROM gone", "member exclusion")
register("clean_members", _clean, f"{_GONE} SELECT cluster_id, sid, species, parent FROM clean", "member exclusion")
register(
    "large_clusters", lambda s, d: curation.large_clusters(_member(s, d), 20).groupBy("cluster_id").agg(F.count("*").alias("n")),
    "SELECT cluster_id, count(*) AS n FROM member GROUP BY cluster_id HAVING count(DISTINCT species) > 20", "member",
)
register(
    "cluster_marker_summary", lambda s, d: curation.cluster_markers(_member(s, d)),
    """WITH per AS (SELECT cluster_id, genes_text, count(*) AS n FROM member GROUP BY cluster_id, genes_text),
    top AS (SELECT cluster_id, genes_text AS g, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, genes_text) AS r FROM per WHERE genes_text <> '') WHERE r = 1)
    SELECT m.cluster_id, string_agg(DISTINCT m.genes_text, '; ' ORDER BY m.genes_text) AS all_markers, count(DISTINCT m.genes_text) AS n_markers, coalesce(any_value(t.g), '') AS top_marker,
    CAST(any_value(t.n) AS DOUBLE) / count(*) AS top_marker_freq, count(*) AS n_sequences, count(DISTINCT m.species) AS n_species FROM member m LEFT JOIN top t ON m.cluster_id = t.cluster_id GROUP BY m.cluster_id""", "member", "top_marker_freq",
)
register(
    "species_cluster_map", lambda s, d: curation.species_clusters(_member(s, d)),
    "SELECT species, string_agg(DISTINCT CAST(cluster_id AS STRING), ',' ORDER BY CAST(cluster_id AS STRING)) AS clusters, count(DISTINCT cluster_id) AS n_clusters FROM member GROUP BY species", "member",
)
register(
    "species_sid_matrix", lambda s, d: curation.accession_matrix(_member(s, d), CLUSTERS),
    "SELECT species, " + ", ".join(f"coalesce(arg_min(sid, ord) FILTER (WHERE cluster_id = {c}), '') AS cid_{c}" for c in CLUSTERS) + " FROM member GROUP BY species", "member",
)
register(
    "cluster_counts", _cluster_counts,
    f"""{_GONE} SELECT o.cluster_id, o.n_original, coalesce(r.n, 0) AS n_removed, coalesce(f.n, 0) AS n_final FROM (SELECT cluster_id, count(DISTINCT species) AS n_original FROM member GROUP BY cluster_id) o
    LEFT JOIN (SELECT cluster_id, count(*) AS n FROM gone GROUP BY cluster_id) r ON o.cluster_id = r.cluster_id LEFT JOIN (SELECT cluster_id, count(*) AS n FROM clean GROUP BY cluster_id) f ON o.cluster_id = f.cluster_id""", "member exclusion",
)


def _marker_summary(s, d):
    m = _member(s, d).where("genes_text != ''").withColumnRenamed("genes_text", "marker")
    return curation.marker_summary(m.groupBy("marker", "cluster_id").agg(F.count("*").alias("n_sequences")), m)


register(
    "marker_summary_assembly", _marker_summary,
    """WITH c AS (SELECT genes_text AS marker, cluster_id, count(*) AS n FROM member WHERE genes_text <> '' GROUP BY genes_text, cluster_id)
    SELECT c.marker, count(*) AS num_clusters, CAST(sum(n) AS BIGINT) AS num_sequences, avg(n) AS mean_seq_per_cluster, CAST(median(n) AS DOUBLE) AS median_seq_per_cluster, min(n) AS min_seq_in_cluster, max(n) AS max_seq_in_cluster,
    any_value(s.k) AS num_species FROM c JOIN (SELECT genes_text AS marker, count(DISTINCT species) AS k FROM member GROUP BY genes_text) s ON c.marker = s.marker GROUP BY c.marker""", "member", "mean_seq_per_cluster median_seq_per_cluster",
)
register(
    "marker_annotation",
    lambda s, d: curation.annotate_markers(canonical(s, d, "description"), "description", names.marker_pattern(MARKERS), canonical(s, d, "dictionary")).select("doc_id", "genes_text"),
    """WITH found AS (SELECT doc_id, regexp_extract_all(regexp_replace(trim(coalesce(description, '')), '\\s+', ' ', 'g'), '(that|the|and|der|de|la)', 0) AS l FROM description),
    kept AS (SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') AS t FROM found)
    SELECT doc_id, coalesce(r.replace, t) AS genes_text FROM kept LEFT JOIN (SELECT search, arg_min(replace, ord) AS replace FROM dictionary GROUP BY search) r ON kept.t = r.search""", "description dictionary",
)
register(
    "marker_merge", lambda s, d: curation.first_per_binomial(canonical(s, d, "sequence_header"), "original_name", F.col("marker"), F.col("ord")),
    "SELECT marker, ord, original_name FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(original_name, '^([^ ]+_[^ ]+).*', '\\1') ORDER BY marker, ord) AS r FROM sequence_header) WHERE r = 1", "sequence_header",
)


register(
    "excluded_records", lambda s, d: canonical(s, d, "title").select("doc_id", names.excluded_record("title", "organism", F.lit(""), F.lit("")).alias("excluded")),
    """SELECT doc_id, regexp_matches(' ' || coalesce(title, '') || ' ', '(?i)[^A-Za-z0-9](predicted|whole genome shotgun|unverified|sp\\.|aff\\.|cf\\.|var\\.|var|variety|subsp\\.|subsp)[^A-Za-z0-9]')
    OR regexp_matches(' ' || organism || ' ', '(?i)[^A-Za-z0-9](synthetic construct|sp\\.|sp|aff|cf|var|var\\.|subsp\\.|subsp|subspecies|x)[^A-Za-z0-9]') AS excluded FROM title""", "title",
)

_ACCEPTED = (
    "accepted_species AS (SELECT DISTINCT regexp_replace(n, '[ -]+', '_', 'g') AS species FROM (SELECT regexp_replace(trim(pureName), '\\s+', ' ', 'g') AS n FROM checklist) "
    "WHERE NOT regexp_matches(n, '(?i)\\b(subsp|ssp|var|forma|f\\.|subg|sect|ser|cf\\.|aff\\.|sp\\.|spp\\.|nr\\.)\\b|×|\\bx\\b') AND regexp_matches(n, '^[A-Z][a-z]+\\s[a-z]+$'))"
)
_RAW = (
    f"WITH {_ACCEPTED}, raw AS (SELECT h.*, m.sid, m.is_outgroup FROM header h LEFT JOIN metadata m ON h.species = m.species AND h.marker_key = m.marker_key), "
    "flagged AS (SELECT r.*, r.sid IS NOT NULL AS matched_to_metadata, a.species IS NOT NULL AS accepted_in_checklist, o.species IS NOT NULL AS is_outgroup_species, a.species IS NOT NULL OR o.species IS NOT NULL AS accepted_or_outgroup, "
    "CASE WHEN r.source_branch = 'ingroup' THEN a.species IS NOT NULL END AS matched_to_checklist, CASE WHEN r.sid IS NULL THEN 'unmatched_metadata' WHEN r.source_branch = 'outgroup' THEN 'accepted_outgroup' "
    "WHEN a.species IS NOT NULL THEN 'accepted_ingroup' WHEN r.source_branch = 'ingroup' THEN 'rejected_ingroup' ELSE 'other' END AS record_status FROM raw r LEFT JOIN accepted_species a ON r.species = a.species "
    "LEFT JOIN (SELECT DISTINCT species FROM metadata WHERE is_outgroup) o ON r.species = o.species)"
)
_COUNTS = (
    "count(*) AS n_records_total, count(*) FILTER (WHERE source_branch = 'ingroup') AS n_records_ingroup, count(*) FILTER (WHERE source_branch = 'outgroup') AS n_records_outgroup, "
    "count(*) FILTER (WHERE accepted_or_outgroup) AS n_records_accepted, count(*) FILTER (WHERE source_branch = 'ingroup' AND NOT accepted_or_outgroup) AS n_records_rejected, count(DISTINCT accepted_or_outgroup) AS n_classes"
)


def _class(mixed, ingroup, outgroup, other):
    return f"CASE WHEN n_records_total <= 1 THEN 'unique' WHEN n_records_ingroup > 0 AND n_records_outgroup > 0 THEN '{mixed}' WHEN n_records_ingroup > 1 THEN '{ingroup}' WHEN n_records_outgroup > 1 THEN '{outgroup}' ELSE '{other}' END AS duplicate_class"


_GROUPS = (
    f"{_RAW}, dups AS (SELECT *, n_classes > 1 AS classification_conflict, {_class('duplicate_mixed', 'duplicate_ingroup', 'duplicate_outgroup', 'duplicate_other')}, n_records_total > 1 AS is_duplicate_species_marker "
    f"FROM (SELECT marker_key, species, {_COUNTS} FROM flagged GROUP BY marker_key, species))"
)
_SELECTED = (
    f"{_GROUPS}, selected AS (SELECT species, marker_key, sid, fasta_name, source_branch, accepted_in_checklist, is_outgroup_species, accepted_or_outgroup FROM (SELECT *, row_number() OVER (PARTITION BY species, marker_key "
    "ORDER BY accepted_or_outgroup DESC, is_outgroup_species DESC, sid, fasta_name, source_branch) AS r FROM flagged WHERE sid IS NOT NULL) WHERE r = 1), final AS (SELECT * FROM selected WHERE accepted_or_outgroup)"
)
_EXPORTED = (
    f"{_SELECTED}, mapped AS (SELECT f.species, f.marker_key, f.sid, f.source_branch, min(k.fasta_name) AS fasta_name FROM final f LEFT JOIN (SELECT DISTINCT marker_key, sid, fasta_name, species, source_branch FROM flagged WHERE sid IS NOT NULL) k "
    "ON f.species = k.species AND f.marker_key = k.marker_key AND f.sid = k.sid AND f.source_branch = k.source_branch GROUP BY f.species, f.marker_key, f.sid, f.source_branch), "
    "exported AS (SELECT h.marker_key, h.fasta_name, h.species, m.source_branch FROM header h JOIN (SELECT DISTINCT marker_key, fasta_name FROM mapped) k ON h.marker_key = k.marker_key AND h.fasta_name = k.fasta_name "
    "LEFT JOIN mapped m ON h.marker_key = m.marker_key AND h.species = m.species AND h.fasta_name = m.fasta_name)"
)
_E1 = "header metadata checklist"


class _Integration:
    """The stages of integration over one set of inputs; ``written`` ones are written once, for queries that read them several times."""

    def __init__(self, s, d, written=()):
        self.headers, self.metadata = canonical(s, d, "header"), canonical(s, d, "metadata")
        self.accepted = integration.accepted_species(canonical(s, d, "checklist"))
        self.written = written

    def _once(self, name, table):
        return cut(table) if name in self.written else table

    @cached_property
    def raw(self):
        return integration.raw_records(self.headers, self.metadata)

    @cached_property
    def flagged(self):
        return self._once("flagged", integration.with_acceptance(self.raw, self.accepted, self.metadata))

    @cached_property
    def groups(self):
        return self._once("groups", integration.duplicate_groups(self.flagged))

    @cached_property
    def selected(self):
        return self._once("selected", integration.select_records(self.flagged))

    @cached_property
    def mapped(self):
        return integration.header_map(self.flagged, self.selected)

    @cached_property
    def exported(self):
        return self._once("exported", integration.exported_records(self.headers, self.mapped))


def _e1(pick, *written):
    return lambda s, d: pick(_Integration(s, d, written))


register("raw_species_metadata", _e1(lambda i: i.raw), f"{_RAW} SELECT species, marker_key, source_branch, fasta_name, sid, is_outgroup FROM raw", _E1)
register("unmatched_metadata", _e1(lambda i: integration.unmatched(i.raw)), f"{_RAW} SELECT DISTINCT marker_key, source_branch, species, fasta_name FROM raw WHERE sid IS NULL", _E1)
register("accepted_species", _e1(lambda i: i.accepted), f"WITH {_ACCEPTED} SELECT species FROM accepted_species", "checklist")
register("raw_with_acceptance", _e1(lambda i: i.flagged), f"{_RAW} SELECT * FROM flagged", _E1)
register("duplicate_groups", _e1(lambda i: i.groups), f"{_GROUPS} SELECT * FROM dups", _E1)
register(
    "sequence_registry", _e1(lambda i: integration.sequence_registry(i.flagged, i.groups)),
    f"{_GROUPS} SELECT f.*, g.n_records_total, g.n_records_ingroup, g.n_records_outgroup, g.classification_conflict, g.duplicate_class, g.is_duplicate_species_marker FROM flagged f LEFT JOIN dups g ON f.marker_key = g.marker_key AND f.species = g.species", _E1,
)
register("selected_records", _e1(lambda i: i.selected), f"{_SELECTED} SELECT * FROM selected", _E1)
register(
    "species_marker_matrix", _e1(lambda i: integration.marker_matrix(i.selected, KEYS)),
    f"{_SELECTED} SELECT species, CASE WHEN is_outgroup_species THEN 'outgroup' ELSE 'ingroup' END AS species_class, " + ", ".join(f"min(sid) FILTER (WHERE marker_key = '{k}') AS {k}" for k in KEYS) + " FROM final GROUP BY 1, 2", _E1,
)
register(
    "duplicate_resolution", _e1(lambda i: integration.duplicate_resolution(i.flagged, i.selected)),
    f"""{_SELECTED} SELECT g.marker_key, g.species, n_records_total, n_records_ingroup, n_records_outgroup, n_records_accepted, n_records_rejected, sid_candidates, fasta_candidates, source_candidates, accepted_status_candidates, n_classes > 1 AS classification_conflict,
    {_class('mixed_ingroup_outgroup', 'ingroup_only', 'outgroup_only', 'other')}, s.sid AS sid_selected, s.fasta_name AS fasta_selected, s.source_branch AS source_selected, s.accepted_or_outgroup AS selected_accepted_or_outgroup FROM
    (SELECT marker_key, species, {_COUNTS}, string_agg(DISTINCT sid, ';' ORDER BY sid) AS sid_candidates, string_agg(DISTINCT fasta_name, ';' ORDER BY fasta_name) AS fasta_candidates, string_agg(DISTINCT source_branch, ';' ORDER BY source_branch) AS source_candidates,
    string_agg(DISTINCT CASE WHEN accepted_or_outgroup THEN 'accepted_or_outgroup' ELSE 'rejected' END, ';') AS accepted_status_candidates FROM flagged GROUP BY marker_key, species) g LEFT JOIN selected s ON g.marker_key = s.marker_key AND g.species = s.species WHERE n_records_total > 1""", _E1,
)
register("selected_header_map", _e1(lambda i: i.mapped), f"{_EXPORTED} SELECT * FROM mapped", _E1)


def _composition(stage, source, group, record):
    return (
        f"SELECT marker_key, '{stage}' AS stage, CASE WHEN grouping(g) = 1 THEN 'total' ELSE g END AS \"group\", count(DISTINCT species) AS n_species, count(DISTINCT {record}) AS n_records "
        f"FROM (SELECT *, {group} AS g FROM {source}) GROUP BY GROUPING SETS ((marker_key, g), (marker_key))"
    )


register(
    "marker_taxon_composition", _e1(lambda i: integration.taxon_composition(i.flagged, i.selected, i.exported), "flagged", "selected"),
    f"{_EXPORTED} " + " UNION ALL ".join((
        _composition("raw", "flagged", "source_branch", "fasta_name"), _composition("selected", "final", "CASE WHEN is_outgroup_species THEN 'outgroup' ELSE 'ingroup' END", "sid"),
        _composition("exported", "exported", "CASE WHEN source_branch = 'outgroup' THEN 'outgroup' ELSE 'ingroup' END", "fasta_name"))), _E1,
)
_Z = lambda cs: ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in cs.split())
register(
    "marker_summary_integration", _e1(lambda i: integration.integration_summary(i.flagged, i.groups, i.selected, i.exported), "flagged", "selected", "exported"),
    f"""{_EXPORTED}, r AS (SELECT marker_key, count(DISTINCT fasta_name) AS n_records_raw_total, count(DISTINCT fasta_name) FILTER (WHERE source_branch = 'ingroup') AS n_records_raw_ingroup, count(DISTINCT fasta_name) FILTER (WHERE source_branch = 'outgroup') AS n_records_raw_outgroup,
    count(DISTINCT species) AS n_species_raw_total, count(DISTINCT species) FILTER (WHERE source_branch = 'ingroup') AS n_species_raw_ingroup, count(DISTINCT species) FILTER (WHERE source_branch = 'outgroup') AS n_species_raw_outgroup,
    count(DISTINCT species) FILTER (WHERE source_branch = 'ingroup' AND accepted_in_checklist) AS n_species_raw_accepted_ingroup, count(DISTINCT species) FILTER (WHERE source_branch = 'ingroup' AND NOT accepted_in_checklist) AS n_species_raw_rejected_ingroup FROM flagged GROUP BY marker_key),
    u AS (SELECT marker_key, count(*) FILTER (WHERE n_records_total > 1) AS n_species_marker_duplicated, sum(greatest(n_records_total - 1, 0)) AS n_duplicate_records_excess_total, sum(greatest(n_records_ingroup - 1, 0)) AS n_duplicate_records_excess_ingroup,
    sum(greatest(n_records_outgroup - 1, 0)) AS n_duplicate_records_excess_outgroup, sum(CASE WHEN n_records_ingroup > 0 AND n_records_outgroup > 0 THEN n_records_total - 1 ELSE 0 END) AS n_duplicate_records_excess_mixed, count(*) FILTER (WHERE classification_conflict) AS n_classification_conflicts FROM dups GROUP BY marker_key),
    c AS (SELECT marker_key, count(DISTINCT species) AS n_species_selected_total, count(DISTINCT species) FILTER (WHERE NOT is_outgroup_species) AS n_species_selected_ingroup, count(DISTINCT species) FILTER (WHERE is_outgroup_species) AS n_species_selected_outgroup, count(DISTINCT sid) AS n_records_selected_total FROM final GROUP BY marker_key),
    x AS (SELECT e.marker_key, count(DISTINCT fasta_name) AS n_sequences_exported, count(DISTINCT e.species) AS n_species_exported_total, count(DISTINCT e.species) FILTER (WHERE NOT k.is_outgroup_species) AS n_species_exported_ingroup, count(DISTINCT e.species) FILTER (WHERE k.is_outgroup_species) AS n_species_exported_outgroup
    FROM exported e LEFT JOIN (SELECT DISTINCT marker_key, species, source_branch, is_outgroup_species FROM final) k ON e.marker_key = k.marker_key AND e.species = k.species AND e.source_branch = k.source_branch GROUP BY e.marker_key),
    z AS (SELECT r.marker_key, {_Z('n_records_raw_total n_records_raw_ingroup n_records_raw_outgroup n_species_raw_total n_species_raw_ingroup n_species_raw_outgroup n_species_raw_accepted_ingroup n_species_raw_rejected_ingroup n_species_marker_duplicated n_duplicate_records_excess_total n_duplicate_records_excess_ingroup n_duplicate_records_excess_outgroup n_duplicate_records_excess_mixed n_classification_conflicts n_species_selected_total n_species_selected_ingroup n_species_selected_outgroup n_records_selected_total n_sequences_exported n_species_exported_total n_species_exported_ingroup n_species_exported_outgroup')}
    FROM r LEFT JOIN u ON r.marker_key = u.marker_key LEFT JOIN c ON r.marker_key = c.marker_key LEFT JOIN x ON r.marker_key = x.marker_key)
    SELECT *, round(100.0::DOUBLE * n_species_raw_accepted_ingroup / nullif(n_species_raw_ingroup, 0), 2) AS pct_species_raw_accepted_ingroup, round(100.0::DOUBLE * n_species_exported_total / nullif(n_species_raw_total, 0), 2) AS pct_species_retained_from_raw,
    round(100.0::DOUBLE * n_sequences_exported / nullif(n_records_raw_total, 0), 2) AS pct_records_retained_from_raw FROM z""", _E1,
)

_TIDY = "CASE WHEN is_outgroup THEN 'accepted_outgroup' WHEN in_phylogeny AND accepted_in_checklist THEN 'sampled_ingroup' WHEN in_phylogeny THEN 'rejected_ingroup_in_tree' WHEN has_sequences AND accepted_in_checklist THEN 'sequenced_not_in_tree' WHEN has_sequences THEN 'rejected_ingroup_no_tree' WHEN accepted_in_checklist THEN 'unsampled_ingroup' ELSE 'other' END"
_REG = (
    "WITH j AS (SELECT coalesce(q.species, a.species) AS species, q.species_class, a.species IS NOT NULL AS accepted_in_checklist FROM sequenced q FULL JOIN accepted a ON q.species = a.species), "
    "reg AS (SELECT *, accepted_in_checklist OR is_outgroup AS accepted_or_outgroup, " + _TIDY + " AS record_status FROM (SELECT j.species, species_class, species_class IS NOT NULL AS has_sequences, t.species IS NOT NULL AS in_phylogeny, accepted_in_checklist, "
    "coalesce(species_class = 'outgroup', false) AS is_outgroup, CASE WHEN species_class IS NOT NULL THEN species_class = 'ingroup' ELSE true END AS is_ingroup FROM j LEFT JOIN (SELECT DISTINCT species FROM in_tree) t ON j.species = t.species)), "
    "full_reg AS (SELECT r.*, c.* EXCLUDE (species) FROM reg r LEFT JOIN conservation c ON r.species = c.species), sampled AS (SELECT * FROM full_reg WHERE in_phylogeny AND is_ingroup)"
)
_R = "sequenced accepted in_tree conservation"


def _registry(s, d):
    return registry.species_registry(canonical(s, d, "sequenced"), canonical(s, d, "accepted"), canonical(s, d, "in_tree"))


def _enriched(s, d):
    return _registry(s, d).join(canonical(s, d, "conservation"), "species", "left")


def _on(operator):
    return lambda s, d: operator(_enriched(s, d))


def _listed(column, top=None, by=""):
    keys = column + (", " + by if by else "")
    counts = f"{_REG}, n AS (SELECT {keys}, count(*) AS n FROM (SELECT unnest(string_split({column}, '; ')) AS {column}{', ' + by if by else ''} FROM sampled WHERE {column} IS NOT NULL) GROUP BY {keys})"
    return f"{counts} SELECT * FROM n" + (f" WHERE n >= (SELECT min(n) FROM (SELECT n FROM n ORDER BY n DESC LIMIT {top}))" if top else "")


_SUMMARY = {
    "Total ingroup species in checklist": "accepted_in_checklist", "Total species with sequences": "has_sequences", "Ingroup species with sequences": "is_ingroup AND has_sequences", "Outgroup species with sequences": "is_outgroup AND has_sequences",
    "Ingroup species in final phylogeny": "in_phylogeny AND is_ingroup", "Outgroup species in final phylogeny": "in_phylogeny AND is_outgroup", "Ingroup species mapped to IUCN assessment": "is_ingroup AND iucn_found",
    "Ingroup species without IUCN assessment": "is_ingroup AND NOT coalesce(iucn_found, false)", "Ingroup species in phylogeny with IUCN assessment": "in_phylogeny AND is_ingroup AND iucn_found",
    "Threatened species in phylogeny (VU/EN/CR) (Ingroup)": "in_phylogeny AND is_ingroup AND iucn_category IN ('VU', 'EN', 'CR')", "Endemic species in phylogeny (Ingroup)": "in_phylogeny AND is_ingroup AND iucn_is_endemic",
}
register("species_registry", _registry, f"{_REG} SELECT * FROM reg", _R)
register("dataset_summary", _on(registry.dataset_summary), f"{_REG} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) FILTER (WHERE {c}) AS value FROM full_reg" for n, c in _SUMMARY.items()), _R)
register("record_status_counts", lambda s, d: registry.status_counts(_registry(s, d)), f"{_REG} SELECT record_status, count(*) AS n FROM reg WHERE accepted_or_outgroup GROUP BY record_status", _R)
register("iucn_categories", _on(registry.category_counts), f"{_REG} SELECT iucn_category, iucn_category_name, count(*) AS n FROM sampled WHERE iucn_found GROUP BY 1, 2", _R)
register(
    "completeness_by_category", _on(registry.completeness_by_category),
    f"{_REG} SELECT iucn_category, count(*) AS n, " + ", ".join(f"quantile_cont(pct_markers, {q}) AS {c}" for q, c in ((0.0, "lowest"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "highest"))) + " FROM sampled WHERE iucn_found GROUP BY 1", _R, "lowest q1 median q3 highest",
)
register("endemic_species", _on(registry.endemic_species), f"{_REG} SELECT species, iucn_category, iucn_endemic_locations FROM sampled WHERE iucn_is_endemic", _R)
register("endemism_by_country", _on(lambda df: registry.listed_counts(df.where("iucn_is_endemic"), "iucn_endemic_locations", 20)), _listed("iucn_endemic_locations", 20), _R)
register("category_by_country", _on(lambda df: registry.listed_counts(df.where("iucn_is_endemic"), "iucn_endemic_locations", None, "iucn_category")), _listed("iucn_endemic_locations", None, "iucn_category"), _R)
register("common_threats", _on(lambda df: registry.listed_counts(df, "iucn_threat_names", 15)), _listed("iucn_threat_names", 15), _R)
register("common_habitats", _on(lambda df: registry.listed_counts(df, "iucn_habitat_names", 15)), _listed("iucn_habitat_names", 15), _R)
register(
    "category_palette", lambda s, d: s.createDataFrame(list(names.CATEGORY_COLOURS.items()), "category string, colour string"),
    "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in names.CATEGORY_COLOURS.items()) + ") t(category, colour)",
)


def _sample_rename(s, d):
    tips, known = canonical(s, d, "sample"), canonical(s, d, "sample_map")
    by_sample = known.where("sample IS NOT NULL").select("sample", F.col("species_name").alias("a"))
    by_run = known.where("run IS NOT NULL").select("run", F.col("species_name").alias("b"))
    df = tips.withColumn("sample", F.when(F.col("tip").contains("PAFTOL"), names.sample_id("tip")))
    return df.join(by_sample, "sample", "left").join(by_run, df["tip"] == by_run["run"], "left").select("event_id", F.coalesce("a", "b", "tip").alias("new_name"))


register(
    "sample_rename", _sample_rename,
    """SELECT event_id, coalesce(a.species_name, b.species_name, tip) AS new_name FROM (SELECT *, CASE WHEN contains(tip, 'PAFTOL') THEN 'P' || right(regexp_extract(tip, '([0-9]+)', 1), 5) END AS sample FROM sample) t
    LEFT JOIN (SELECT * FROM sample_map WHERE sample IS NOT NULL) a ON t.sample = a.sample LEFT JOIN (SELECT * FROM sample_map WHERE run IS NOT NULL) b ON t.tip = b.run""", "sample sample_map",
)
_ASSESSED = "concat('{\"assessment_id\": ', CAST(event_id AS STRING), ', \"latest\": ', CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END, ', \"red_list_category_code\": \"', event_type, '\"}')"
_PLACE = "concat('{\"description\": {\"en\": \"L', CAST(event_id % 9 AS STRING), '\"}, \"code\": \"c', CAST(event_id % 9 AS STRING), '\", \"is_endemic\": ', CASE WHEN event_id % 9 < 2 THEN 'true' ELSE 'false' END, '}')"


def _records(s, d):
    """Nested records, one for each user: their events as assessments and places."""
    listed = lambda e: F.array_join(F.sort_array(F.collect_list(F.expr(e))), ",")
    text = F.concat(F.lit('{"taxon": {"family_name": "F'), F.col("user_id") % 7, F.lit('"}, "assessments": ['), listed(_ASSESSED), F.lit('], "assessment": {"locations": ['), listed(_PLACE), F.lit("]}}"))
    return s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(text.alias("json")).select(F.concat(F.lit("User"), "user_id").alias("species_clean"), "json")


_EMPTY = ", ".join(f"CAST(NULL AS STRING) AS iucn_{x}" for x in (
    "authority common_name synonyms year url category_name criteria population_trend population_trend_code habitat_names habitat_codes threat_names threat_codes system_names system_codes "
    "realm_names realm_codes growth_form_names growth_form_codes use_trade_names use_trade_codes doc_range doc_habitats doc_threats doc_rationale").split())  # fmt: skip
register(
    "conservation_flat", lambda s, d: registry.flatten_records(_records(s, d)),
    f"""WITH e AS (SELECT *, {_ASSESSED} AS t, 'L' || CAST(event_id % 9 AS STRING) AS l, 'c' || CAST(event_id % 9 AS STRING) AS c, event_id % 9 < 2 AS endemic FROM events)
    SELECT 'User' || CAST(user_id AS STRING) AS species_clean, true AS iucn_found, 'F' || CAST(user_id % 7 AS STRING) AS iucn_family, {_EMPTY},
    coalesce(arg_min(event_type, t) FILTER (WHERE event_type = 'view'), arg_min(event_type, t)) AS iucn_category, bool_or(event_type = 'view') AS iucn_latest,
    string_agg(DISTINCT l, '; ' ORDER BY l) AS iucn_locations, string_agg(DISTINCT c, '; ' ORDER BY c) AS iucn_location_codes, CAST(count(DISTINCT l) AS INT) AS iucn_num_locations,
    string_agg(DISTINCT l, '; ' ORDER BY l) FILTER (WHERE endemic) AS iucn_endemic_locations, string_agg(DISTINCT c, '; ' ORDER BY c) FILTER (WHERE endemic) AS iucn_endemic_location_codes,
    CAST(count(DISTINCT l) FILTER (WHERE endemic) AS INT) AS iucn_num_endemic_locations, bool_or(endemic) AS iucn_is_endemic FROM e GROUP BY user_id""",
)

register(
    "calibration_config", lambda s, d: dating.calibration_lines(canonical(s, d, "calibration"), canonical(s, d, "taxonomy"), canonical(s, d, "listed"), ["clade", "family"]),
    """WITH g AS (SELECT mrca, "min" AS lo, "max" AS hi, string_agg(DISTINCT t.taxon, ' ' ORDER BY t.taxon) AS tips FROM calibration c JOIN taxonomy t ON c."value" = t.clade WHERE used_in_analysis AND t.taxon IN (SELECT taxon FROM listed) GROUP BY mrca, lo, hi HAVING count(DISTINCT t.taxon) >= 2)
    SELECT mrca, 0 AS line_no, 'mrca = ' || mrca || ' ' || tips AS line FROM g UNION ALL SELECT mrca, 1, printf('min = %s %f', mrca, lo) FROM g UNION ALL SELECT mrca, 2, printf('max = %s %f', mrca, hi) FROM g""", "calibration taxonomy listed",
)
register("best_smoothing", lambda s, d: dating.best_smoothing(canonical(s, d, "smoothing")), "SELECT run, smoothing, chi_square FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY chi_square, smoothing) AS r FROM smoothing) WHERE r = 1", "smoothing")
register("priming_mode", lambda s, d: dating.priming_mode(canonical(s, d, "priming")), "SELECT options, count(*) AS n FROM priming GROUP BY options ORDER BY n DESC, options LIMIT 1", "priming")
register("bootstrap_plan", lambda s, d: dating.bootstrap_plan(s), "SELECT CAST(i AS INT) AS replicate, CAST(111 + i * 1000 AS INT) AS seed, 500 AS trees FROM range(1, 5) t(i)")
register(
    "replicate_configs", lambda s, d: dating.replicate_configs(canonical(s, d, "age").select(F.col("rep").alias("tree_no")), 100, 7, 0.1),
    """SELECT tree_no, printf('treefile = rep_%d.tre' || chr(10) || 'smooth = 0.1' || chr(10) || 'numsites = 12700' || chr(10) || 'outfile = rep_%d.dated.tre', tree_no, tree_no) AS config
    FROM (SELECT rep AS tree_no FROM age ORDER BY md5('7:' || rep), rep LIMIT 100)""", "age",
)
register(
    "age_intervals", lambda s, d: dating.age_intervals(canonical(s, d, "age")),
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY age, rep) AS r, count(*) OVER (PARTITION BY node) AS n FROM age),
    w AS (SELECT a.node, a.age AS low, b.age AS high, row_number() OVER (PARTITION BY a.node ORDER BY b.age - a.age, a.age, b.age) AS k FROM r a JOIN r b ON a.node = b.node AND b.r = a.r + CAST(ceil(0.95::DOUBLE * a.n) AS BIGINT) - 1)
    SELECT w.node, m.n, m.mean_age, w.low AS hpd_low, w.high AS hpd_high FROM w JOIN (SELECT node, count(*) AS n, avg(age) AS mean_age FROM age GROUP BY node) m ON w.node = m.node WHERE k = 1""", "age", "mean_age hpd_low hpd_high",
)
register(
    "age_labels", lambda s, d: canonical(s, d, "age").select("rep", names.age_label(F.col("age") / 128 * 16).alias("label")),
    "SELECT rep, regexp_replace(printf('%.1f', round_even(age / 128 * 16, 1)), '\\.0+$', '') AS label FROM age", "age",
)
