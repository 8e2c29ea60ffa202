"""Scalar columns over names, headers and sequences.  All are built-in expressions: no Python UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank and qualifier words that make a name no accepted binomial.
RANK_WORDS = ("subsp", "ssp", "var", "forma", r"f\.", "subg", "sect", "ser", r"cf\.", r"aff\.", r"sp\.", r"spp\.", r"nr\.")
#: Category codes and their published colours.
CATEGORY_COLOURS = {
    "EX": "#000000", "EW": "#5C155A", "CR": "#D81E05", "EN": "#FC7F3F", "VU": "#F9E814",
    "NT": "#CCE226", "LC": "#60C659", "DD": "#D1D1C6", "NE": "#FFFFFF",
}
#: Terms that exclude a sequence record, by the field they look at.
EXCLUDED_TITLE = ("predicted", "whole genome shotgun", "unverified", "sp.", "aff.", "cf.", "var.", "var", "variety", "subsp.", "subsp")
EXCLUDED_ORGANISM = ("synthetic construct", "sp.", "sp", "aff", "cf", "var", "var.", "subsp.", "subsp", "subspecies", "x")
EXCLUDED_KEYWORD = ("TSA",)
EXCLUDED_FILTER = ("refseq",)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_species_name(c: str | Column) -> Column:
    """Drop dots, white-space runs to ``_``, then trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), r"\.", ""), r"\s+", "_"))


def normalize_marker(c: str | Column) -> Column:
    """Trim and squeeze white space; an en dash becomes a hyphen."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"\s+", " "), "–", "-")


def marker_pattern(markers: list[str]) -> str:
    """Alternation of literal markers, longest first (equal lengths in the given order)."""
    unique = list(dict.fromkeys(m for m in markers if m))
    return "(" + "|".join(re.sub(r"([^A-Za-z0-9 _])", r"\\\1", m) for m in sorted(unique, key=len, reverse=True)) + ")"


def marker_text(description: str | Column, pattern: str) -> Column:
    """Markers of a description, unique in order of appearance, joined by comma."""
    found = F.regexp_extract_all(normalize_marker(F.coalesce(_col(description), F.lit(""))), F.lit(pattern), F.lit(0))
    return F.array_join(F.array_distinct(F.transform(found, normalize_marker)), ", ")


def first_binomial(c: str | Column) -> Column:
    """``Genus_species`` before the first further field; other texts unchanged."""
    return F.regexp_replace(_col(c), "^([^ ]+_[^ ]+).*", "$1")


def clean_ambiguous(c: str | Column) -> Column:
    return F.regexp_replace(F.upper(_col(c)), "[^ACGT-]", "N")


def count_char(c: str | Column, char: str) -> Column:
    """Occurrences of a character; null and empty give 0."""
    text = F.coalesce(_col(c), F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def strip_marker_prefix(c: str | Column) -> Column:
    """Base name without extension and the four known prefixes, in order."""
    out = F.regexp_replace(F.element_at(F.split(_col(c), "/"), -1), r"\.fasta$", "")
    for prefix in ("ALN_clean_input_FASTA_MARKER_", "ALN_masked_final_", "MARKER_", "Masked_"):
        out = F.regexp_replace(out, f"^{prefix}", "")
    return out


def marker_key(c: str | Column) -> Column:
    """File name to marker key: separators to one ``_``, none at the ends."""
    out = F.regexp_replace(F.trim(strip_marker_prefix(c)), r"[\s/\\.\-]+", "_")
    return F.regexp_replace(out, "^_+|_+$", "")


def normalize_species(c: str | Column) -> Column:
    return F.regexp_replace(F.trim(_col(c)), "[ -]+", "_")


def header_species(c: str | Column) -> Column:
    """Species of a FASTA header: its first field; empty gives null."""
    return normalize_species(F.nullif(F.trim(F.split_part(_col(c), F.lit("|"), F.lit(1))), F.lit("")))


def clean_taxon_name(c: str | Column) -> Column:
    """First field, lower case, other characters to one ``_``, first letter capital."""
    low = F.regexp_replace(F.lower(F.split_part(_col(c), F.lit("|"), F.lit(1))), "[^a-z0-9 ]", " ")
    joined = F.replace(F.trim(F.regexp_replace(low, r"\s+", " ")), F.lit(" "), F.lit("_"))
    return F.concat(F.upper(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))


def header_accession(c: str | Column) -> Column:
    """Last field of a header; else its last ``_`` piece if it has a digit; else ``-``."""
    fields = F.split(_col(c), r"\|")
    pieces = F.split(F.trim(F.element_at(fields, 1)), "_")
    return (
        F.when(F.size(fields) >= 2, F.trim(F.element_at(fields, -1)))
        .when((F.size(pieces) > 1) & F.element_at(pieces, -1).rlike("[0-9]"), F.element_at(pieces, -1))
        .otherwise("-")
    )


def is_accepted_name(c: str | Column, compat: bool = False) -> Column:
    """Whether a name is a plain binomial.  ``compat`` also drops every name with a letter x in it."""
    name = F.regexp_replace(F.trim(_col(c)), r"\s+", " ")
    hybrid = "x" if compat else "×"
    excluded = name.rlike(rf"(?i)\b({'|'.join(RANK_WORDS)})\b|{hybrid}|\bx\b")
    return F.coalesce(~excluded & name.rlike(r"^[A-Z][a-z]+\s[a-z]+$"), F.lit(False))


def standardize_taxon(c: str | Column) -> Column:
    """Name with runs of white space, dashes and ``_`` as single ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"[\s_-]+", "_"), "^_|_$", "")


def genus_of(c: str | Column) -> Column:
    return F.split_part(_col(c), F.lit("_"), F.lit(1))


def sample_id(c: str | Column) -> Column:
    """``P`` and the last five of the first digits of a sample label."""
    return F.concat(F.lit("P"), F.right(F.regexp_extract(_col(c), "([0-9]+)", 1), F.lit(5)))


def support_class(c: str | Column) -> Column:
    return F.when(_col(c) >= 0.90, ">= 90").when(_col(c) >= 0.70, "70-89").otherwise("< 70")


def age_label(c: str | Column, digits: int = 1) -> Column:
    """Rounded half to even, without a trailing zero fraction; a number below zero that rounds to zero keeps its sign; null stays null."""
    rounded = F.bround(_col(c), digits)
    signed = F.when(rounded == 0, F.signum(_col(c)) * F.lit(0.0)).otherwise(rounded)
    return F.when(rounded.isNotNull(), F.regexp_replace(F.format_string(f"%.{digits}f", signed), r"\.0+$", ""))


def excluded_record(title: str | Column, organism: str | Column, keywords: str | Column, filters: str | Column) -> Column:
    """Whether a record falls under one of the exclusion terms (words, any case)."""

    def any_of(c: str | Column, words: tuple[str, ...]) -> Column:
        escaped = "|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", w) for w in words)
        return F.coalesce(_col(c).rlike(rf"(?i)(?<![A-Za-z0-9])({escaped})(?![A-Za-z0-9])"), F.lit(False))

    return any_of(title, EXCLUDED_TITLE) | any_of(organism, EXCLUDED_ORGANISM) | any_of(keywords, EXCLUDED_KEYWORD) | any_of(filters, EXCLUDED_FILTER)


def unique_in_order(value: str | Column, order: str | Column, sep: str) -> Column:
    """Aggregate: distinct non-null values in order of first appearance, joined.

    It collects the rows of a group: combine them to the first row of each value before.
    """
    pairs = F.sort_array(F.collect_list(F.when(_col(value).isNotNull(), F.struct(_col(order).alias("o"), _col(value).cast("string").alias("v")))))
    return F.array_join(F.array_distinct(F.transform(pairs, lambda p: p["v"])), sep)


def unique_sorted(value: str | Column, sep: str = ";") -> Column:
    """Aggregate: sorted distinct non-empty values, joined; null if there are none."""
    text = _col(value).cast("string")
    values = F.array_sort(F.collect_set(F.when(text != "", text)))
    return F.when(F.size(values) > 0, F.array_join(values, sep))
