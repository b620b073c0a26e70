"""Source catalogue: which years exist, what each publishes, how years compare.

The values below are fixed values; the functions turn them into small dimension
tables (one row per configured year, fewer than ten) that joins may broadcast.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum.schemas import INDICATORS
from cadastrum.session import small_table

SALES_YEARS = (2014, 2015, 2016, 2017, 2018, 2019, 2020, 2021, 2022, 2023, 2024)

LEVELS = ("commune", "department_official", "department_derived")
OFFICIAL = "official_insee"
DERIVED = "derived_from_communes"
SECONDARY_DECILES = ("d2_income", "d3_income", "d4_income", "d5_income", "d6_income", "d7_income", "d8_income")
TREND_INDICATORS = ("median_income", "d1_income", "d9_income")

INCOME_CATALOGUE = {
    "dataset": "filosofi",
    "default_year": 2023,
    "known_missing_years": [2022],
    "sources": {
        "2017": {
            "enabled": True,
            "source_type": "data_gouv",
            "dispositif": "filosofi",
            "source_generation": "legacy",
            "comparable_with_previous_years": False,
            "secondary_deciles_comparable_with_previous_years": False,
        },
        "2018": {
            "enabled": True,
            "source_type": "insee_xlsx_zip",
            "dispositif": "filosofi",
            "source_generation": "historical",
            "comparable_with_previous_years": True,
            "secondary_deciles_comparable_with_previous_years": False,
        },
        "2019": {
            "enabled": True,
            "source_type": "insee_xlsx_zip",
            "dispositif": "filosofi",
            "source_generation": "historical",
            "comparable_with_previous_years": True,
            "secondary_deciles_comparable_with_previous_years": True,
        },
        "2020": {
            "enabled": True,
            "source_type": "insee_xlsx_zip",
            "dispositif": "filosofi",
            "source_generation": "historical",
            "comparable_with_previous_years": True,
            "secondary_deciles_comparable_with_previous_years": True,
        },
        "2021": {
            "enabled": True,
            "source_type": "insee_xlsx_zip",
            "dispositif": "filosofi",
            "source_generation": "historical",
            "comparable_with_previous_years": True,
            "secondary_deciles_comparable_with_previous_years": True,
        },
        "2023": {
            "enabled": True,
            "source_type": "insee_filosofi2_multigeography",
            "dispositif": "filosofi2",
            "source_generation": "filosofi2",
            "comparable_with_previous_years": False,
            "secondary_deciles_comparable_with_previous_years": False,
            "methodological_break": True,
            "methodological_break_label": "Passage à FiLoSoFi 2",
        },
    },
}

# Canonical column -> year -> published source column (absent years publish none).
PUBLISHED_COLUMNS = {
    "geography_code": {
        2017: "CODGEO", 2018: "CODGEO", 2019: "CODGEO", 2020: "CODGEO", 2021: "CODGEO", 2023: "GEO",
    },
    "geography_name": {2018: "LIBGEO", 2019: "LIBGEO", 2020: "LIBGEO", 2021: "LIBGEO"},
    "median_income": {2017: "MED17", 2018: "Q218", 2019: "Q219", 2020: "Q220", 2021: "Q221", 2023: "MED_SL"},
    "d1_income": {2017: "D117", 2018: "D118", 2019: "D119", 2020: "D120", 2021: "D121", 2023: "D1_SL"},
    "d2_income": {2018: "D218", 2019: "D219", 2020: "D220", 2021: "D221", 2023: "D2_SL"},
    "d3_income": {2018: "D318", 2019: "D319", 2020: "D320", 2021: "D321", 2023: "D3_SL"},
    "d4_income": {2018: "D418", 2019: "D419", 2020: "D420", 2021: "D421", 2023: "D4_SL"},
    "d5_income": {},
    "d6_income": {2018: "D618", 2019: "D619", 2020: "D620", 2021: "D621", 2023: "D6_SL"},
    "d7_income": {2018: "D718", 2019: "D719", 2020: "D720", 2021: "D721", 2023: "D7_SL"},
    "d8_income": {2018: "D818", 2019: "D819", 2020: "D820", 2021: "D821", 2023: "D8_SL"},
    "d9_income": {2017: "D917", 2018: "D918", 2019: "D919", 2020: "D920", 2021: "D921", 2023: "D9_SL"},
    "poverty_rate": {
        2017: "TP6017", 2018: "TP6018", 2019: "TP6019", 2020: "TP6020", 2021: "TP6021", 2023: "PR_MD60",
    },
    "tax_households": {2017: "NBMENFISC17", 2018: "NBMEN18", 2019: "NBMEN19", 2020: "NBMEN20", 2021: "NBMEN21"},
    "population": {
        2017: "NBPERSMENFISC17", 2018: "NBPERS18", 2019: "NBPERS19", 2020: "NBPERS20", 2021: "NBPERS21",
    },
}

# Long-table measure code -> canonical column.
MEASURES = {
    "MED_SL": "median_income",
    "D1_SL": "d1_income",
    "D2_SL": "d2_income",
    "D3_SL": "d3_income",
    "D4_SL": "d4_income",
    "D6_SL": "d6_income",
    "D7_SL": "d7_income",
    "D8_SL": "d8_income",
    "D9_SL": "d9_income",
    "PR_MD60": "poverty_rate",
}

# Columns the long source table must carry.
LONG_SOURCE_COLUMNS = (
    "FILOSOFI_MEASURE", "GEO", "GEO_OBJECT", "UNIT_MEASURE", "CONF_STATUS",
    "OBS_STATUS", "UNIT_MULT", "TIME_PERIOD", "OBS_VALUE",
)

INDICATOR_LABELS = {
    "median_income": "Revenu médian",
    "d1_income": "Décile D1",
    "d2_income": "Décile D2",
    "d3_income": "Décile D3",
    "d4_income": "Décile D4",
    "d5_income": "Décile D5",
    "d6_income": "Décile D6",
    "d7_income": "Décile D7",
    "d8_income": "Décile D8",
    "d9_income": "Décile D9",
    "poverty_rate": "Taux de pauvreté",
    "tax_households": "Ménages fiscaux",
    "population": "Population",
}

# Raw source column -> canonical column, as ordered patterns over folded names.
COLUMN_PATTERNS = {
    "commune_code": ("^commune_code$", "^code_commune$", "^codgeo$", "^code_geo$", "^geo$"),
    "commune_name": ("^commune_name$", "^nom_commune$", "^libgeo$", "^libelle_commune$", "^commune$"),
    "department_code": ("^department_code$", "^code_departement$", "^dep$", "^coddep$"),
    "median_income": ("^median_income$", r"^med\d*$", r"^q2\d*$", "mediane", "^med_sl$"),
    "d1_income": ("^d1_income$", r"^d1\d*$", "^d1_sl$"),
    "d2_income": ("^d2_income$", r"^d2\d*$", "^d2_sl$"),
    "d3_income": ("^d3_income$", r"^d3\d*$", "^d3_sl$"),
    "d4_income": ("^d4_income$", r"^d4\d*$", "^d4_sl$"),
    "d5_income": ("^d5_income$", r"^d5\d*$"),
    "d6_income": ("^d6_income$", r"^d6\d*$", "^d6_sl$"),
    "d7_income": ("^d7_income$", r"^d7\d*$", "^d7_sl$"),
    "d8_income": ("^d8_income$", r"^d8\d*$", "^d8_sl$"),
    "d9_income": ("^d9_income$", r"^d9\d*$", "^d9_sl$"),
    "poverty_rate": ("^poverty_rate$", r"^tp60\d*$", "pauvrete", "^pr_md60$"),
    "tax_households": ("^tax_households$", r"^nbmenfisc\d*$", r"^nbmen\d*$"),
    "population": ("^population$", r"^nbpersmenfisc\d*$", r"^nbpers\d*$"),
    "year": ("^year$",),
}


def source_years(spark: SparkSession, catalogue: dict | None = None, enabled_only: bool = False) -> DataFrame:
    """One row per catalogue year with its flags and provenance defaults."""
    sources = (catalogue or INCOME_CATALOGUE)["sources"]
    rows = []
    for year, source in sorted(sources.items(), key=lambda item: int(item[0])):
        if enabled_only and source.get("enabled") is not True:
            continue
        dispositif = source.get("dispositif") or "filosofi"
        fallback = "filosofi2" if dispositif == "filosofi2" else "historical"
        rows.append(
            (
                int(year),
                dispositif,
                (source.get("source_generation") or "").strip() or fallback,
                source.get("comparable_with_previous_years") is True,
                source.get("secondary_deciles_comparable_with_previous_years") is True,
                source.get("methodological_break") is True,
                source.get("methodological_break_label") or f"Methodological break for {dispositif}",
            )
        )
    return small_table(
        spark,
        rows,
        "year long, dispositif string, source_generation string, comparable boolean,"
        " secondary_comparable boolean, methodological_break boolean, break_label string",
    )


def published_columns(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """One row per year: the canonical columns that have a published source column."""
    mapping = mapping or PUBLISHED_COLUMNS
    by_year: dict[int, list[str]] = {}
    for column, years in mapping.items():
        for year, source in years.items():
            by_year.setdefault(int(year), [])
            if source:
                by_year[int(year)].append(column)
    return small_table(spark, sorted(by_year.items()), "year long, published array<string>")


def source_column_names(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """Long form of the column mapping: (canonical_column, year, source_column)."""
    rows = [
        (column, int(year), source)
        for column, years in (mapping or PUBLISHED_COLUMNS).items()
        for year, source in years.items()
        if source
    ]
    return small_table(spark, rows, "canonical_column string, year long, source_column string")


def indicator_labels(spark: SparkSession) -> DataFrame:
    rows = [(name, INDICATOR_LABELS[name], position) for position, name in enumerate(INDICATORS, start=1)]
    return small_table(spark, rows, "indicator string, label string, position int")


def configured_years(catalogue: dict | None = None) -> list[int]:
    sources = (catalogue or INCOME_CATALOGUE)["sources"]
    return sorted(int(year) for year, source in sources.items() if source.get("enabled") is True)


def catalogue_documents(spark: SparkSession, *documents: dict) -> DataFrame:
    """Catalogue JSON documents as a table, the input of the catalogue rules."""
    rows = [(i, json.dumps(document)) for i, document in enumerate(documents)]
    return spark.createDataFrame(rows, "catalogue_id long, document string")
