"""Rules of the source catalogue, evaluated on catalogue documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATASET = "filosofi"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("ABSENT"))


def _part(document: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(document, f"$.{path}", kind)


def _year(text: Column) -> Column:
    return F.trim(text).try_cast("long")


def catalogue_violations(documents: DataFrame) -> DataFrame:
    """One row per broken rule: (catalogue_id, rule, detail).

    ``documents`` has (catalogue_id, document); a document is judged within its
    row, so nothing is shuffled however many there are.
    """
    parsed = documents.select("catalogue_id", F.try_parse_json("document").alias("doc"))
    doc = F.col("doc")
    entries = F.map_entries(_part(doc, "sources", "map<string,variant>"))
    sources = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"),
            _year(e["key"]).alias("year"),
            _kind(e["value"]).alias("kind"),
            _kind(_part(e["value"], "enabled")).alias("enabled_kind"),
            F.coalesce(_part(e["value"], "enabled", "boolean"), F.lit(False)).alias("enabled"),
            F.trim(F.coalesce(_part(e["value"], "source_type", "string"), F.lit(""))).alias("source_type"),
        ),
    )
    facts = parsed.select(
        "catalogue_id",
        _kind(doc).startswith("OBJECT").alias("is_object"),
        _part(doc, "dataset", "string").alias("dataset"),
        _kind(_part(doc, "years")).alias("years_kind"),
        _kind(_part(doc, "default_year")).alias("default_kind"),
        _year(_part(doc, "default_year", "string")).alias("default_year"),
        _kind(_part(doc, "known_missing_years")).alias("missing_kind"),
        F.coalesce(_part(doc, "known_missing_years", "array<string>"), F.array().cast("array<string>")).alias("missing"),
        F.coalesce(sources, F.array()).alias("sources"),
    )
    years = F.transform("sources", lambda s: s["year"])
    missing_years = F.transform("missing", _year)

    def broken(condition: Column, rule: str, detail: Column | None = None) -> Column:
        row = F.struct(F.lit(rule).alias("rule"), (F.lit("") if detail is None else detail).alias("detail"))
        return F.when(condition, F.array(row)).otherwise(F.array().cast("array<struct<rule:string,detail:string>>"))

    def each(items: Column, rule: str, detail) -> Column:
        return F.transform(items, lambda s: F.struct(F.lit(rule).alias("rule"), detail(s).alias("detail")))

    def where(condition) -> Column:
        return F.filter("sources", condition)

    def key(s: Column) -> Column:
        return s["key"]

    default = F.filter("sources", lambda s: s["year"] == F.col("default_year"))
    repeated = F.filter(
        F.array_distinct(years), lambda y: F.size(F.filter(years, lambda other: other == y)) > 1
    )
    has_default = F.col("default_year").isNotNull()
    violations = F.concat(
        broken(F.coalesce(F.col("dataset") != DATASET, F.lit(True)), "dataset_name", F.coalesce("dataset", F.lit(""))),
        broken(F.col("years_kind") != "ABSENT", "redundant_years"),
        broken(F.col("default_kind") == "ABSENT", "default_year_missing"),
        broken((F.col("default_kind") != "ABSENT") & ~has_default, "default_year_not_integer"),
        broken(~F.col("missing_kind").startswith("ARRAY") & (F.col("missing_kind") != "ABSENT"), "missing_years_not_list"),
        broken(F.exists(missing_years, lambda y: y.isNull()), "missing_year_not_integer"),
        broken(F.size(F.array_distinct(missing_years)) < F.size(missing_years), "missing_year_duplicate"),
        broken(F.size("sources") == 0, "sources_empty"),
        each(where(lambda s: s["year"].isNull()), "source_year_not_integer", key),
        each(repeated, "source_year_duplicate", lambda y: y.cast("string")),
        each(where(lambda s: ~s["kind"].startswith("OBJECT")), "source_not_object", key),
        each(
            where(lambda s: s["kind"].startswith("OBJECT") & (s["enabled_kind"] == "ABSENT")), "enabled_missing", key
        ),
        each(
            where(lambda s: ~s["enabled_kind"].isin("ABSENT", "BOOLEAN")), "enabled_not_boolean", key
        ),
        each(
            where(lambda s: (s["enabled_kind"] == "BOOLEAN") & s["enabled"] & (s["source_type"] == "")),
            "source_type_missing",
            key,
        ),
        broken(has_default & (F.size(default) == 0), "default_year_absent", F.col("default_year").cast("string")),
        broken(
            has_default & (F.size(default) > 0) & ~F.exists(default, lambda s: s["enabled"]),
            "default_year_disabled",
            F.col("default_year").cast("string"),
        ),
        each(F.array_intersect(missing_years, years), "missing_year_available", lambda y: y.cast("string")),
    )
    root = broken(~F.col("is_object"), "not_an_object")
    chosen = F.when(F.col("is_object"), violations).otherwise(root)
    return facts.select("catalogue_id", F.inline(chosen))
