"""Listing pipelines: raw scraped strings -> clean table -> features -> profile.

The whole cleaning step is one projection of built-in expressions, so
Catalyst fuses it into the scan stage (no shuffle, no Python).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.functions.text import (AIRCON_RULES, FUEL_RULES, GEARBOX_RULES, coalesce_price,
                                      cut_suffix, derive_age, literal_null_text, parse_quantity,
                                      recode_by_substring, safe_ratio, split_power, strip_nbsp,
                                      take_token, year_token)

AS_OF_YEAR = 2026


def clean_raw_listings(raw: DataFrame, as_of_year: int = AS_OF_YEAR, compat: bool = False,
                       on_error: str = "raise") -> DataFrame:
    """B6-B11 over the raw listing strings (see ``FX_RAW`` for the layout)."""
    kw, hp = split_power("power_raw", on_error=on_error)
    year = year_token("year_raw")
    cylinder = take_token(strip_nbsp("cylinder_raw"), " ", 1)
    return raw.select(
        "id",
        parse_quantity(coalesce_price("price_raw", "discount_raw"), 2, cast="long",
                       on_error=on_error).alias("price"),
        take_token("title", " ", 1).alias("brand"),
        year.alias("year"),
        derive_age(year, as_of_year, on_error).alias("age"),
        parse_quantity("km_raw", 2, cast="long", on_error=on_error).alias("kilometers"),
        F.trim(cut_suffix("persons_raw", 2)).alias("persons"),
        parse_quantity("weight_raw", 2, on_error=on_error).alias("own_weight"),
        parse_quantity("trunk_raw", 5, strip_first=False, on_error=on_error).alias("trunk"),
        (cylinder.try_cast("double") if on_error == "null" else cylinder.cast("double")).alias("cylinder"),
        kw.alias("power_kw"),
        hp.alias("power_hp"),
        literal_null_text(take_token("inspection_raw", "/", 1), compat).alias("roadworthiness"),
        "fuel", "gearbox", "aircon",
    )


def generalize_categories(df: DataFrame) -> DataFrame:
    """B12 on the three recoded categories."""
    return df.withColumns({
        "fuel_generalized": recode_by_substring("fuel", FUEL_RULES),
        "gearbox_generalized": recode_by_substring("gearbox", GEARBOX_RULES),
        "aircon_generalized": recode_by_substring("aircon", AIRCON_RULES),
    })


def listing_features(df: DataFrame) -> DataFrame:
    """Kilometres per year of age (age 0 keeps the kilometres)."""
    return df.withColumn("km_per_year", safe_ratio("kilometers", "age"))


def flagship(raw: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """Clean -> recode -> feature -> profile: listing count and mean price,
    kilometres, age, power and km/year per generalized fuel (NULL fuel
    dropped, as a pandas pivot table does).  One scan, one projection, one
    partially aggregated shuffle of at most (partitions x fuels) rows."""
    clean = listing_features(generalize_categories(clean_raw_listings(raw, as_of_year)))
    return (clean.where(F.col("fuel_generalized").isNotNull())
            .groupBy("fuel_generalized")
            .agg(F.count(F.lit(1)).alias("listings"),
                 F.avg("price").alias("mean_price"),
                 F.avg("kilometers").alias("mean_km"),
                 F.avg("age").alias("mean_age"),
                 F.avg("power_kw").alias("mean_power_kw"),
                 F.avg("km_per_year").alias("mean_km_per_year")))
