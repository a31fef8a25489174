"""Field catalogue: declared columns with types and roles."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions.scalars import to_date, to_number

# Spark type of each catalogue type.
TYPES = {
    "Char": T.StringType(),
    "Text": T.StringType(),
    "Numeric": T.DecimalType(18, 2),
    "Decimal": T.DecimalType(18, 2),
    "Date": T.DateType(),
    "Timestamp": T.TimestampNTZType(),
    "Boolean": T.BooleanType(),
}


@dataclass(frozen=True)
class Catalogue:
    fields: list[dict[str, Any]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str | Mapping[str, Any]) -> Catalogue:
        """Validate and normalise: known types, legal unique lower-case names, one target, one date."""
        raw = json.loads(text) if isinstance(text, str) else text
        fields = [dict(f, field_name=f["field_name"].lower()) for f in raw["fields"]]
        names = [f["field_name"] for f in fields]
        if bad := [n for n in names if not re.fullmatch(r"\w+", n, re.ASCII)]:
            raise ValueError(f"illegal field names {bad}")
        if len(set(names)) != len(names):
            raise ValueError("field names repeat")
        if bad := [f["data_type"] for f in fields if f["data_type"] not in TYPES]:
            raise ValueError(f"unknown types {bad}")
        for role in ("is_target_variable", "is_date_field"):
            if sum(bool(f.get(role)) for f in fields) != 1:
                raise ValueError(f"exactly one field needs {role}")
        return cls(fields)

    @property
    def target(self) -> str:
        return next(f["field_name"] for f in self.fields if f.get("is_target_variable"))

    @property
    def date(self) -> str:
        return next(f["field_name"] for f in self.fields if f.get("is_date_field"))

    @property
    def columns(self) -> list[str]:
        """Dimension-table columns."""
        return [f["field_name"] for f in self.fields if f["field_name"] not in (self.target, self.date)]

    @property
    def dimensions(self) -> list[str]:
        return [f["field_name"] for f in self.fields if f["field_name"] in self.columns and not f.get("is_characteristic")]

    @property
    def unique_keys(self) -> list[str]:
        return [f["field_name"] for f in self.fields if f.get("is_unique_key") and f["field_name"] in self.columns]

    def schema(self) -> T.StructType:
        """Typed schema; roles and lengths travel as column metadata."""
        roles = ("is_characteristic", "is_unique_key", "is_target_variable", "is_date_field", "parent_field_name", "field_length")
        return T.StructType(
            [
                T.StructField(
                    f["field_name"], TYPES[f["data_type"]], True,
                    {k: f[k] for k in roles if f.get(k) is not None},
                )
                for f in self.fields
            ]
        )


def typed_load(df: DataFrame, catalogue: Catalogue, keep: Sequence[str] = ()) -> DataFrame:
    """Landed text to catalogue types. A cell that does not parse is NULL and named in ``rejected``."""
    schema = {f.name: f.dataType for f in catalogue.schema().fields if f.name in df.columns}
    typed = {
        n: to_number(F.col(n), t.simpleString()) if isinstance(t, T.DecimalType) else to_date(F.col(n)) if isinstance(t, T.DateType) else F.col(n).try_cast(t)
        for n, t in schema.items()
    }
    failed = [F.when(F.col(n).isNotNull() & typed[n].isNull(), F.lit(n)) for n in schema]
    rejected: Column = F.concat_ws(",", *failed)
    return df.select(*keep, *[c.alias(n) for n, c in typed.items()], rejected.alias("rejected"))
