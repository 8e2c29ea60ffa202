"""Canonical inputs built from the stored tables.

Each adapter is one SQL text with table names in braces.  The text uses only functions that Spark and
DuckDB share, so the same definition feeds the operators and the SQL that checks them; the two array
dialects that differ are given by ``{#...}`` marks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SITES = 120
_SPECIES = "'Opuntia_' || translate(CAST({0} AS STRING), '0123456789', 'abcdefghij')"
_CONS = "(CAST(substr(source, 4) AS INT) * 5 + pos * 13) % 4"
_BASE = (
    "CASE WHEN (doc_id * 31 + pos * 17) % 23 = 0 OR pos = 60 THEN '-' WHEN (doc_id * 13 + pos * 29) % 97 = 0 THEN 'N' "
    "WHEN (doc_id * 7919 + pos * 104729) % 211 < (pos % 7) * 2 "
    f"THEN substr('ACGT', CAST(({_CONS} + 1 + (doc_id + pos) % 3) % 4 + 1 AS INT), 1) ELSE substr('ACGT', CAST({_CONS} + 1 AS INT), 1) END"
)
_SEGMENT = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END"
_TIP = "replace(n_name, '_', '') || '_' || CAST(c_custkey AS STRING)"


def tree(tree_id: str, moved: str, source: str = "") -> str:
    """Nodes of a tree: customers under nations under regions; ``moved`` customers under segments."""
    node = lambda i, p, s, frm: (
        f"SELECT {tree_id} AS tree_id, CAST({i} AS BIGINT) AS node_id, CAST({p} AS BIGINT) AS parent_id, CAST(NULL AS STRING) AS label, "
        f"1.0 + ({i}) % 5 * CAST(0.25 AS DOUBLE) AS branch_length, CAST(({s}) % 100 AS DOUBLE) / 100 AS support, false AS is_tip FROM {frm}{source}"
    )
    tips = (
        f"SELECT {tree_id}, CAST(1000 + c_custkey AS BIGINT), CAST(CASE WHEN {moved} THEN 200 + {_SEGMENT} ELSE 100 + c_nationkey END AS BIGINT), {_TIP}, "
        f"CAST(0.5 AS DOUBLE) + c_acctbal / 10000, CAST(NULL AS DOUBLE), true FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey{source}"
    )
    return " UNION ALL ".join(
        (
            node("0", "NULL", "100", "(SELECT 1 AS one) r"),
            node("1 + r_regionkey", "0", "60 + r_regionkey * 11", "{region}"),
            node("100 + n_nationkey", "1 + n_regionkey", "n_nationkey * 37", "{nation}"),
            node("200 + s", "0", "s * 23 + 40", "(SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) g"),
            tips,
        )
    )


def tree_set(trees: str, lacks: str) -> str:
    """Many trees over customers in eight subgroups of each nation that differ by tree; tips for which ``lacks`` holds are missing."""
    node = lambda i, p, frm: f"SELECT CAST(rep AS STRING) AS tree_id, CAST({i} AS BIGINT) AS node_id, CAST({p} AS BIGINT) AS parent_id, CAST(NULL AS STRING) AS label, CAST(1 AS DOUBLE) AS branch_length, CAST(NULL AS DOUBLE) AS support, false AS is_tip FROM {frm} CROSS JOIN ({trees}) t"
    eight = "(" + " UNION ALL ".join(f"SELECT {k} AS g" for k in range(8)) + ") e"
    return " UNION ALL ".join(
        (
            node("0", "NULL", "(SELECT 1 AS one) r"),
            node("1 + r_regionkey", "0", "{region}"),
            node("100 + n_nationkey", "1 + (n_regionkey + CASE WHEN n_nationkey % 5 = rep % 7 THEN rep ELSE 0 END) % 5", "{nation}"),
            node("10000 + n_nationkey * 8 + g", "100 + n_nationkey", "{nation} CROSS JOIN " + eight),
            f"SELECT CAST(rep AS STRING), CAST(1000000 + c_custkey AS BIGINT), CAST(10000 + c_nationkey * 8 + (c_custkey + c_custkey % (2 + rep % 6)) % 8 AS BIGINT), {_TIP}, CAST(1 AS DOUBLE), CAST(NULL AS DOUBLE), true FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey CROSS JOIN ({trees}) t WHERE NOT ({lacks})",
        )
    )


def _numbers(first: int, last: int) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS rep" for k in range(first, last + 1))


ADAPTERS = {
    # Cluster members; rows of one accession in several clusters are plentiful.
    "member": (
        "SELECT DISTINCT l_linenumber AS cluster_id, CAST(l_orderkey AS STRING) AS sid, replace(p_name, ' ', '_') AS species, CAST(l_suppkey % 5 AS STRING) AS parent, "
        "CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE p_brand END AS genes_text, "
        "CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 AS ord "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
    ),
    "exclusion": "SELECT DISTINCT l_linenumber AS cluster_id, CAST(l_orderkey AS STRING) AS sid, 'manual exclusion' AS reason FROM {lineitem} WHERE l_returnflag = 'R'",
    "dictionary": (
        "SELECT 'the, and' AS search, 'conjunction' AS replace, 1 AS ord UNION ALL SELECT 'the', 'article', 2 UNION ALL SELECT 'the', 'ignored', 3 UNION ALL SELECT 'de', 'preposition', 4"
    ),
    "description": "SELECT doc_id, text AS description FROM {documents}",
    "header": (
        f"SELECT 'M' || CAST(o_orderkey % 7 AS STRING) AS marker_key, CASE WHEN o_orderstatus = 'F' THEN 'outgroup' ELSE 'ingroup' END AS source_branch, {_SPECIES.format('o_custkey')} AS species, "
        f"{_SPECIES.format('o_custkey')} || '|' || CAST(o_orderkey AS STRING) AS fasta_name FROM {{orders}}"
    ),
    "metadata": (
        f"SELECT {_SPECIES.format('o_custkey')} AS species, 'M' || CAST(o_orderkey % 7 AS STRING) AS marker_key, 'A' || CAST(o_orderkey AS STRING) AS sid, o_custkey % 5 = 0 AND o_orderstatus = 'F' AS is_outgroup "
        "FROM {orders} WHERE o_orderstatus <> 'P'"
    ),
    "checklist": (
        "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'Opuntia ' || n || ' subsp. minor' WHEN c_mktsegment = 'MACHINERY' THEN 'opuntia ' || n WHEN c_mktsegment = 'FURNITURE' THEN 'Opuntia x ' || n "
        "ELSE '  Opuntia  ' || n || ' ' END AS pureName FROM (SELECT c_mktsegment, translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS n FROM {customer}) c"
    ),
    # Aligned sequences around a mutated consensus; integer arithmetic only.
    "alignment": f"SELECT source AS marker, 'Taxon_' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING) AS name, doc_id AS ord, {{#join:{_BASE}}} AS seq FROM {{documents}} WHERE source IS NOT NULL",
    # Whole texts as sequences: of any length, in both cases; only letters of the Latin alphabet count as states.
    "ragged": "SELECT source AS marker, 'Taxon_' || CAST(doc_id AS STRING) AS name, doc_id AS ord, translate(text, ' .,;:!?ß', '--NN') AS seq FROM {documents} WHERE source IS NOT NULL",
    "file_name": "SELECT doc_id, 'in/' || CASE doc_id % 4 WHEN 0 THEN 'ALN_masked_final_' WHEN 1 THEN 'MARKER_' WHEN 2 THEN 'Masked_' ELSE '' END || lang || '-' || source || '.fasta' AS path FROM {documents}",
    "sequence_header": (
        "SELECT source AS marker, doc_id AS ord, CASE doc_id % 4 WHEN 0 THEN 'genus  SPECIES-' || lang || '|x|S' || CAST(doc_id AS STRING) WHEN 1 THEN 'Genus_' || lang || '_AB' || CAST(doc_id AS STRING) "
        "WHEN 2 THEN 'Plain ' || lang ELSE 'Two_' || lang || '_words' END AS original_name FROM {documents}"
    ),
    "tree_a": tree("'A'", "false"),
    "trees": " UNION ALL ".join((tree("'A'", "false"), tree("'B'", "c_custkey % 7 = 0"), tree("'C'", "c_custkey % 3 <> 0"))),
    "replicate": tree("CAST(rep AS STRING)", "(c_custkey * 31 + rep * 17) % 11 < rep % 3", " CROSS JOIN (SELECT 1 AS rep UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) p"),
    # Twenty dated trees; their branch lengths and some groupings differ.
    "dated": (
        "SELECT tree_id, node_id, parent_id, label, branch_length * (1 + CAST((node_id % 1000 * 7 + CAST(tree_id AS BIGINT) * 3) % 5 AS DOUBLE) / 10) AS branch_length, support, is_tip FROM ("
        + tree("CAST(rep AS STRING)", "(c_custkey * 31 + rep * 17) % 11 < rep % 3 AND c_nationkey % (2 + rep % 4) = 0", f" CROSS JOIN ({_numbers(1, 20)}) p") + ") d"
    ),
    "tree_set": tree_set(_numbers(1, 120), "false"),
    "ragged_tree_set": tree_set(_numbers(1, 12), "rep % 3 > 0 AND c_custkey % (5 + rep) = rep % 2"),
    "taxonomy": f"SELECT {_TIP} AS taxon, replace(n_name, '_', '') AS clade, c_mktsegment AS family, CAST(n_regionkey AS STRING) AS subfamily, c_custkey AS ord FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey",
    "tip": (
        f"SELECT t AS tree, {_TIP} AS taxon FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey CROSS JOIN (SELECT 'A' AS t UNION ALL SELECT 'B' UNION ALL SELECT 'C') x "
        "WHERE t = 'A' OR (t = 'B' AND c_custkey % 5 <> 0 AND c_nationkey <> 3) OR (t = 'C' AND c_custkey % 3 <> 0)"
    ),
    "listed": f"SELECT {_TIP} AS taxon FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 7",
    "constraint": f"SELECT {_TIP} AS taxon, c_mktsegment AS clade FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_acctbal > 0 UNION ALL SELECT {_TIP}, 'Extra' FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 0",
    "calibration": (
        "SELECT 'N' || CAST(n_nationkey AS STRING) AS mrca, 'clade' AS `column`, replace(n_name, '_', '') AS `value`, CAST(min(c_acctbal) AS DOUBLE) AS `min`, CAST(max(c_acctbal) AS DOUBLE) AS `max`, n_nationkey % 3 <> 0 AS used_in_analysis "
        "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"
    ),
    "smoothing": "SELECT c_nationkey AS run, CAST(c_custkey AS DOUBLE) AS smoothing, c_acctbal AS chi_square FROM {customer}",
    "age": "SELECT c_nationkey AS node, c_custkey AS rep, c_acctbal AS age FROM {customer}",
    "priming": "SELECT o_orderpriority AS options FROM {orders}",
    # Species registry with conservation columns.
    "sequenced": "SELECT 'Sp' || CAST(c_custkey AS STRING) AS species, CASE WHEN c_nationkey < 3 THEN 'outgroup' ELSE 'ingroup' END AS species_class FROM {customer} WHERE c_acctbal > 1000",
    "accepted": "SELECT 'Sp' || CAST(c_custkey AS STRING) AS species FROM {customer} WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'New' || CAST(s_suppkey AS STRING) FROM {supplier}",
    "in_tree": "SELECT 'Sp' || CAST(c_custkey AS STRING) AS species FROM {customer} WHERE c_acctbal > 2000",
    "conservation": (
        "SELECT 'Sp' || CAST(c_custkey AS STRING) AS species, c_custkey % 4 <> 0 AS iucn_found, CASE c_custkey % 5 WHEN 0 THEN 'VU' WHEN 1 THEN 'EN' WHEN 2 THEN 'CR' WHEN 3 THEN 'LC' ELSE NULL END AS iucn_category, "
        "CASE c_custkey % 5 WHEN 0 THEN 'Vulnerable' WHEN 1 THEN 'Endangered' WHEN 2 THEN 'Critically Endangered' WHEN 3 THEN 'Least Concern' ELSE NULL END AS iucn_category_name, c_custkey % 3 = 0 AS iucn_is_endemic, "
        "CASE WHEN c_custkey % 3 = 0 THEN 'Country' || CAST(c_nationkey AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '; Country' || CAST((c_nationkey + 1) % 25 AS STRING) ELSE '' END ELSE NULL END AS iucn_endemic_locations, "
        "CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE 'Threat' || CAST(c_custkey % 17 AS STRING) || '; Threat' || CAST(20 + c_custkey % 5 AS STRING) END AS iucn_threat_names, "
        "CASE WHEN c_custkey % 7 = 2 THEN NULL ELSE c_mktsegment || '; Habitat' || CAST(c_custkey % 13 AS STRING) END AS iucn_habitat_names, CAST(c_custkey % 12 AS DOUBLE) * 100 / 11 AS pct_markers FROM {customer}"
    ),
    "sample": (
        "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'PAFTOL_' || CAST(100000 + user_id * 37 AS STRING) || '_x' WHEN user_id % 3 = 1 THEN 'SRR' || CAST(user_id AS STRING) ELSE event_type END AS tip FROM {events}"
    ),
    "sample_map": "SELECT DISTINCT 'P' || right(CAST(100000 + user_id * 37 AS STRING), 5) AS sample, CAST(NULL AS STRING) AS run, 'Species_' || CAST(user_id AS STRING) AS species_name FROM {events} WHERE user_id % 2 = 0 UNION SELECT DISTINCT CAST(NULL AS STRING), 'SRR' || CAST(user_id AS STRING), 'Run_' || CAST(user_id AS STRING) FROM {events} WHERE user_id % 5 <> 0",
    "title": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'PREDICTED: ' ELSE '' END || text AS title, CASE doc_id % 7 WHEN 1 THEN 'Opuntia sp.' WHEN 2 THEN 'Opuntia x rara' ELSE 'Opuntia varia' END AS organism FROM {documents}",
}
_JOIN = {
    "spark": f"array_join(transform(sequence(1, {SITES}), pos -> \\1), '')",
    "duckdb": f"array_to_string(list_transform(range(1, {SITES + 1}), lambda pos: \\1), '')",
}


def _dialect(text: str, engine: str) -> str:
    return re.sub(r"\{#join:(.*?)\}", _JOIN[engine], text)


def canonical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical input as a DataFrame over the stored tables."""
    text = _dialect(ADAPTERS[name], "spark")
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def definition(name: str) -> str:
    """The same input as DuckDB SQL."""
    text = _dialect(ADAPTERS[name], "duckdb")
    return re.sub(r"\{(\w+)\}", r"\1", text).replace("`", '"')
