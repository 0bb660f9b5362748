"""Scalar shaping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands in order of urgency, their ranks, and the age limits of the bands.
BAND_RANK = {"P1": 0, "P2": 1, "P3": 2}
AGE_BANDS = [(1, "<1"), (3, "1-2"), (18, "3-17"), (40, "18-39"), (65, "40-64")]
OLDEST_BAND = "65+"
ADULT_AGE = 18
# Fixed patterns: keys hidden in file names, and planted files.
PERSON_FILE = r"^(person\d+)_"
SERIES_FILE = r"^((?:NORMAL2-)?IM-\d+)-"
PLANTED_FILE = r"^QC-([A-Z]+)-(.+)$"


def hash_unit(*parts: Column | str) -> Column:
    """A value in [0, 1) from the md5 of the parts joined by ':'; the same everywhere, every time."""
    text = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pseudonym(salt: str, person: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), person.cast("string")), 256), 1, 16)


def age_years(on: Column, birth: Column) -> Column:
    return F.floor(F.months_between(on, birth) / 12).cast("int")


def age_band(age: Column) -> Column:
    out = F.when(age.isNull(), "UNKNOWN")
    for limit, name in AGE_BANDS:
        out = out.when(age < limit, name)
    return out.otherwise(OLDEST_BAND)


def population_of(age: Column) -> Column:
    return F.when(age >= ADULT_AGE, "adult").when(age.isNotNull(), "pediatric")


def in_scope(population: Column, age: Column) -> Column:
    """An item of unknown age is in every population."""
    return (age.isNull() | (population == "all")
            | ((population == "adult") & (age >= ADULT_AGE))
            | ((population == "pediatric") & (age < ADULT_AGE)))


def priority_band(probability: Column, threshold: Column, p1: Column) -> Column:
    """P1 never starts below the operating threshold."""
    return (F.when(probability >= F.greatest(p1, threshold), "P1")
             .when(probability >= threshold, "P2").otherwise("P3"))


def band_rank(band: Column) -> Column:
    out = None
    for name, rank in BAND_RANK.items():
        out = F.when(band == name, rank) if out is None else out.when(band == name, rank)
    return out


def worklist_rank(band: Column, probability: Column) -> list[Column]:
    """P1, P2 by falling probability; then P3 with NA, then unscored, both in arrival order."""
    tier = F.when(band == "P1", 0).when(band == "P2", 1).when(band.isin("P3", "NA"), 2).otherwise(3)
    urgency = F.when(band.isin("P1", "P2"), -F.coalesce(probability, F.lit(0.0))).otherwise(F.lit(0.0))
    return [tier, urgency]


def truth_flag(finding: Column, wanted: str) -> Column:
    return F.when(finding == wanted, 1).otherwise(0)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end) / F.lit(60.0)


def person_from_file(name: Column, label: Column | None = None) -> Column:
    """Person key of a file name: personN_..., [NORMAL2-]IM-N-..., else the name without its suffix."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    key = F.coalesce(F.nullif(F.regexp_extract(name, PERSON_FILE, 1), F.lit("")),
                     F.nullif(F.regexp_extract(name, SERIES_FILE, 1), F.lit("")), stem)
    return key if label is None else F.concat_ws(":", label, key)


def planted_kind(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, PLANTED_FILE, 1), F.lit(""))


def planted_original(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, PLANTED_FILE, 2), F.lit(""))


def label_flag(labels: Column, wanted: str) -> Column:
    return F.array_contains(labels, wanted).cast("int")


def label_text(labels: Column, empty: str) -> Column:
    return F.when(F.size(labels) > 0, F.array_join(labels, "|")).otherwise(F.lit(empty))


def label_recode(flag: Column, labels: Column, positive: str, none_found: str) -> Column:
    return (F.when(flag == 1, positive).when(labels == none_found, "NORMAL").otherwise("OTHER"))


def version_string(model: Column, feature_version: Column, commit: Column, default_model: str) -> Column:
    base = F.concat(F.lit("fv"), feature_version, F.lit("-"), F.substring(commit, 1, 7))
    return F.when(model == default_model, base).otherwise(F.concat(model, F.lit("-"), base))


def config_hash(*fields: Column) -> Column:
    """Fingerprint of a definition: 16 hex digits over its JSON, fields in the given order."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256), 1, 16)


def round_scaled(value: Column, digits: int) -> Column:
    """Half-up rounding of the scaled double, as SQL engines do it: the value is not snapped to a short decimal first."""
    scale = float(10 ** digits)
    return F.round(value * scale) / scale


def ratio(part: Column, whole: Column, digits: int | None = 4) -> Column:
    """NULL on an empty denominator."""
    out = F.try_divide(part.cast("double"), F.nullif(whole, F.lit(0)).cast("double"))
    return out if digits is None else F.round(out, digits)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """0.0 on an empty denominator, as model evaluation wants it."""
    return F.coalesce(ratio(part, whole, None), F.lit(0.0))
