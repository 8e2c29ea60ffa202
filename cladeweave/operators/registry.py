"""Species registry, conservation records and the tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of a fetched record that are read.
RECORD_SCHEMA = (
    "taxon struct<family_name string, authority string, common_names array<struct<name string>>, synonyms array<struct<name string>>>, "
    "assessments array<struct<assessment_id bigint, latest boolean, red_list_category_code string, year_published string, url string>>, "
    "assessment struct<red_list_category struct<description struct<en string>>, criteria string, population_trend struct<description struct<en string>, code string>, "
    "locations array<struct<description struct<en string>, code string, is_endemic boolean>>, "
    "habitats array<struct<description struct<en string>, code string>>, threats array<struct<description struct<en string>, code string>>, "
    "systems array<struct<description struct<en string>, code string>>, biogeographical_realms array<struct<description struct<en string>, code string>>, "
    "growth_forms array<struct<description struct<en string>, code string>>, use_and_trade array<struct<description struct<en string>, code string>>, "
    "documentation struct<range string, habitats string, threats string, rationale string>>"
)


def _collapse(values: Column) -> Column:
    """Distinct non-null values in order, joined; null if there are none."""
    kept = F.array_distinct(F.array_compact(values))
    return F.when(F.size(kept) > 0, F.array_join(kept, "; "))


def flatten_records(raw: DataFrame, text: str = "json") -> DataFrame:
    """One flat row for each species from nested records ``species_clean, json``."""
    r = raw.select("species_clean", F.from_json(text, RECORD_SCHEMA).alias("r"))
    found = F.coalesce(F.size("r.assessments") > 0, F.lit(False))
    latest = F.filter("r.assessments", lambda a: F.coalesce(a["latest"], F.lit(False)))
    chosen = F.when(F.size(latest) > 0, latest[0]).otherwise(F.col("r.assessments")[0])
    r = r.withColumn("found", found).withColumn("a", F.when(found, chosen)).withColumn("full", F.when(found, F.col("r.assessment")))
    en = lambda p: F.transform(f"full.{p}", lambda x: x["description"]["en"])
    code = lambda p: F.transform(f"full.{p}", lambda x: x["code"])
    endemic = F.filter("full.locations", lambda x: F.coalesce(x["is_endemic"], F.lit(False)))
    endemic_names = F.array_distinct(F.array_compact(F.transform(endemic, lambda x: x["description"]["en"])))
    listed = {"habitats": "habitat", "threats": "threat", "systems": "system", "biogeographical_realms": "realm", "growth_forms": "growth_form", "use_and_trade": "use_trade"}
    doc = {"range": "range", "habitats": "habitats", "threats": "threats", "rationale": "rationale"}
    has = F.size("full.locations") > 0
    return r.select(
        "species_clean", F.col("found").alias("iucn_found"), F.when(found, F.col("r.taxon.family_name")).alias("iucn_family"), F.when(found, F.col("r.taxon.authority")).alias("iucn_authority"),
        F.when(F.col("found"), _collapse(F.col("r.taxon.common_names.name"))).alias("iucn_common_name"), F.when(F.col("found"), _collapse(F.col("r.taxon.synonyms.name"))).alias("iucn_synonyms"),
        F.col("a.red_list_category_code").alias("iucn_category"), F.col("a.year_published").alias("iucn_year"), F.col("a.latest").alias("iucn_latest"), F.col("a.url").alias("iucn_url"),
        F.col("full.red_list_category.description.en").alias("iucn_category_name"), F.col("full.criteria").alias("iucn_criteria"),
        F.col("full.population_trend.description.en").alias("iucn_population_trend"), F.col("full.population_trend.code").alias("iucn_population_trend_code"),
        _collapse(en("locations")).alias("iucn_locations"), _collapse(code("locations")).alias("iucn_location_codes"), F.when(has, F.size(F.array_distinct(F.array_compact(en("locations"))))).alias("iucn_num_locations"),
        _collapse(F.transform(endemic, lambda x: x["description"]["en"])).alias("iucn_endemic_locations"), _collapse(F.transform(endemic, lambda x: x["code"])).alias("iucn_endemic_location_codes"),
        F.when(has, F.size(endemic_names)).alias("iucn_num_endemic_locations"), F.when(F.col("found"), F.coalesce(F.size(endemic_names) > 0, F.lit(False))).alias("iucn_is_endemic"),
        *(x for p, n in listed.items() for x in (_collapse(en(p)).alias(f"iucn_{n}_names"), _collapse(code(p)).alias(f"iucn_{n}_codes"))),
        *(F.col(f"full.documentation.{p}").alias(f"iucn_doc_{n}") for p, n in doc.items()),
    )


def species_registry(sequenced: DataFrame, checklist: DataFrame, in_tree: DataFrame) -> DataFrame:
    """Full join of species with sequences (``species, species_class``) and checklist species, with status."""
    tree = in_tree.select("species").distinct().withColumn("_t", F.lit(True))
    df = sequenced.join(checklist.withColumn("_c", F.lit(True)), "species", "full").join(tree, "species", "left")
    has, acc, in_phy = F.col("has_sequences"), F.col("accepted_in_checklist"), F.col("in_phylogeny")
    df = df.select("species", "species_class", F.col("species_class").isNotNull().alias("has_sequences"), F.col("_t").isNotNull().alias("in_phylogeny"), F.col("_c").isNotNull().alias("accepted_in_checklist"))
    df = df.withColumn("is_outgroup", F.coalesce(F.col("species_class") == "outgroup", F.lit(False))).withColumn("is_ingroup", F.when(has, F.col("species_class") == "ingroup").otherwise(True))
    df = df.withColumn("accepted_or_outgroup", acc | F.col("is_outgroup"))
    status = (
        F.when(F.col("is_outgroup"), "accepted_outgroup").when(in_phy & acc, "sampled_ingroup").when(in_phy & ~acc, "rejected_ingroup_in_tree")
        .when(has & acc, "sequenced_not_in_tree").when(has & ~acc, "rejected_ingroup_no_tree").when(~has & acc, "unsampled_ingroup").otherwise("other")
    )
    return df.withColumn("record_status", status)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Eleven counts of a registry with conservation columns, one row for each."""
    inside, out, seq, tree, found = (F.col(c) for c in ("is_ingroup", "is_outgroup", "has_sequences", "in_phylogeny", "iucn_found"))
    hit = F.coalesce(found, F.lit(False))
    metrics = {
        "Total ingroup species in checklist": F.col("accepted_in_checklist"), "Total species with sequences": seq, "Ingroup species with sequences": inside & seq, "Outgroup species with sequences": out & seq,
        "Ingroup species in final phylogeny": tree & inside, "Outgroup species in final phylogeny": tree & out, "Ingroup species mapped to IUCN assessment": inside & hit, "Ingroup species without IUCN assessment": inside & ~hit,
        "Ingroup species in phylogeny with IUCN assessment": tree & inside & hit, "Threatened species in phylogeny (VU/EN/CR) (Ingroup)": tree & inside & F.col("iucn_category").isin("VU", "EN", "CR"),
        "Endemic species in phylogeny (Ingroup)": tree & inside & F.col("iucn_is_endemic"),
    }
    counts = df.agg(*(F.count_if(c).alias(f"m{k}") for k, c in enumerate(metrics.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"m{k}").alias("value")) for k, n in enumerate(metrics))))
    return counts.select(rows.alias("r")).select("r.*")


def status_counts(df: DataFrame) -> DataFrame:
    return df.where("accepted_or_outgroup").groupBy("record_status").agg(F.count("*").alias("n"))


def _sampled(df: DataFrame) -> DataFrame:
    return df.where("in_phylogeny AND is_ingroup")


def category_counts(df: DataFrame) -> DataFrame:
    return _sampled(df).where("iucn_found").groupBy("iucn_category", "iucn_category_name").agg(F.count("*").alias("n"))


def completeness_by_category(df: DataFrame) -> DataFrame:
    """Quartiles of marker completeness in each category."""
    q = F.percentile("pct_markers", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    out = _sampled(df).where("iucn_found").groupBy("iucn_category").agg(F.count("*").alias("n"), q.alias("q"))
    return out.select("iucn_category", "n", *(F.col("q")[k].alias(c) for k, c in enumerate(("lowest", "q1", "median", "q3", "highest"))))


def endemic_species(df: DataFrame) -> DataFrame:
    return _sampled(df).where("iucn_is_endemic").select("species", "iucn_category", "iucn_endemic_locations")


def listed_counts(df: DataFrame, column: str, top: int | None = None, *by: str) -> DataFrame:
    """Counts of the values of a ``; `` list; ``top`` keeps the most frequent values and their ties."""
    rows = _sampled(df).where(F.col(column).isNotNull()).select(*by, F.explode(F.split(column, "; ")).alias(column))
    n = rows.groupBy(column, *by).agg(F.count("*").alias("n"))
    if top is None:
        return n
    least = n.orderBy(F.desc("n")).limit(top).agg(F.min("n").alias("_least"))
    return n.crossJoin(F.broadcast(least)).where("n >= _least").drop("_least")


def marker_presence(matrix: DataFrame, markers: list[str]) -> DataFrame:
    """Whether each species has each marker, from a matrix with ``-`` for absence."""
    return matrix.unpivot("species", markers, "marker", "accession").select("species", "marker", (F.col("accession") != "-").alias("present"))
