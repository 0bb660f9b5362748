"""A source contract compiled to Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed formats of the typed columns.
PATTERNS = {"timestamp": "yyyy-MM-dd HH:mm:ss", "date": "yyyy-MM-dd", "date8": "yyyyMMdd", "time6": "HHmmss"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    entity: str
    key: str
    fields: tuple[Field, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


def cleaned(value: Column) -> Column:
    """Trimmed; blank is NULL."""
    return F.when(F.trim(value) != "", F.trim(value))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def missing_reason(field: Field, value: Column) -> Column:
    if not field.required:
        return F.lit(None).cast("string")
    return F.when(cleaned(value).isNull(), F.lit(f"{field.name}: missing"))


def type_reason(field: Field, value: Column) -> Column:
    v = cleaned(value)
    if field.type in PATTERNS:
        parsed = F.try_to_timestamp(v, F.lit(PATTERNS[field.type]))
    elif field.type == "int":
        parsed = v.try_cast("bigint")
    else:
        return F.lit(None).cast("string")
    return F.when(v.isNotNull() & parsed.isNull(),
                  F.concat(F.lit(f"{field.name}: not a {field.type} ("), _quoted(v), F.lit(")")))


def values_reason(field: Field, value: Column) -> Column:
    if not field.values:
        return F.lit(None).cast("string")
    v = cleaned(value)
    allowed = "[" + ", ".join(f"'{a}'" for a in field.values) + "]"
    return F.when(v.isNotNull() & ~v.isin(*field.values),
                  F.concat(F.lit(f"{field.name}: "), _quoted(v), F.lit(f" not in {allowed}")))


def reasons(contract: Contract, value_of=F.col, parse_error: Column | None = None) -> Column:
    """Every reason in column order joined by '; ', NULL when the record is valid.

    A record that could not be parsed has its parse error as the only reason; a badly typed value is not
    also held against the allowed list.
    """
    joined = _joined(contract, value_of)
    text = F.when(joined != "", joined)
    return text if parse_error is None else F.coalesce(parse_error, text)


def _joined(contract: Contract, value_of) -> Column:
    """concat_ws leaves out NULLs, so no array has to be built and filtered."""
    return F.concat_ws("; ", *[F.coalesce(missing_reason(f, value_of(f.name)), type_reason(f, value_of(f.name)),
                                          values_reason(f, value_of(f.name))) for f in contract.fields])


def annotated(df: DataFrame, contract: Contract, parse_error: str | None = None) -> DataFrame:
    """df with a reasons column: the one pass that both sides of the split read (write it before splitting)."""
    text = F.when(F.col("_why") != "", F.col("_why"))
    joined = df.withColumn("_why", _joined(contract, F.col))
    return joined.select(*df.columns, (F.coalesce(F.col(parse_error), text) if parse_error else text).alias("reasons"))


def valid_rows(annotated_df: DataFrame, contract: Contract, keep: list[str] = ()) -> DataFrame:
    return annotated_df.where(F.col("reasons").isNull()).select(
        *keep, *[cleaned(F.col(n)).alias(n) for n in contract.names])


def quarantined_rows(annotated_df: DataFrame, contract: Contract, keep: list[str] = ()) -> DataFrame:
    """Rejected records with every reason and the record as it came, missing fields left out."""
    return annotated_df.where(F.col("reasons").isNotNull()).select(
        *keep, F.lit(contract.entity).alias("entity"), "reasons",
        F.to_json(F.struct(*[F.col(n) for n in contract.names])).alias("record"))


def quarantine_summary(quarantine: DataFrame, by: list[str]) -> DataFrame:
    """Records per distinct reason text. One row per reason, so a flood of different reasons stays distributed."""
    return quarantine.groupBy(*by, "reasons").agg(F.count(F.lit(1)).alias("records"))
