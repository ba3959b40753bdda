"""Metadata filters: a dict becomes one Column over a JSON column. Missing keys, nulls and unfit types never match."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, functions as F

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


class _Value:
    """One key of the metadata, as text and as a value of a Python value's type."""

    def __init__(self, metadata: Column, key: str) -> None:
        self.variant, self.path = F.try_parse_json(metadata), _path(key)
        self.kind = F.schema_of_variant(F.try_variant_get(self.variant, self.path, "variant"))

    def present(self) -> Column:
        return self.kind.isNotNull()

    def as_type_of(self, value: Any) -> Column:
        text = isinstance(value, str)
        flag = isinstance(value, bool)
        wanted = "string" if text else "boolean" if flag else "double"
        got = F.try_variant_get(self.variant, self.path, wanted)
        fits = self.kind == "STRING" if text else self.kind == "BOOLEAN" if flag else self.kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
        return F.when(fits, got)

    def equals(self, value: Any) -> Column:
        if value is None:
            return self.kind == "VOID"
        if isinstance(value, (list, dict)):
            return F.to_json(F.try_variant_get(self.variant, self.path, "variant")) == json.dumps(value, separators=(",", ":"))
        same = self.as_type_of(value) == F.lit(value if isinstance(value, (str, bool)) else float(value))
        member = F.try_variant_get(self.variant, self.path, "array<string>" if isinstance(value, str) else "array<boolean>" if isinstance(value, bool) else "array<double>")
        held = F.array_contains(member, F.lit(value if isinstance(value, (str, bool)) else float(value)))
        return F.when(self.kind.startswith("ARRAY"), F.coalesce(held, F.lit(False))).otherwise(F.coalesce(same, F.lit(False)))

    def operator(self, name: str, wanted: Any) -> Column | None:
        if name in _COMPARE:
            return _COMPARE[name](self.as_type_of(wanted), F.lit(wanted if isinstance(wanted, (str, bool)) else float(wanted)))
        if name == "$ne":
            return ~self.equals(wanted)
        if name in ("$in", "$nin"):
            any_of = F.lit(False)
            for one in wanted:
                any_of = any_of | self.equals(one)
            return any_of if name == "$in" else ~any_of
        return None


def metadata_filter(criteria: Mapping[str, Any] | None, metadata: Column | str = "metadata") -> Column:
    """All keys of criteria: a value to equal or be listed, or a dict of $gt $gte $lt $lte $ne $in $nin; other operators are ignored."""
    column = F.col(metadata) if isinstance(metadata, str) else metadata
    out = F.lit(True)
    for key, wanted in (criteria or {}).items():
        value = _Value(column, key)
        if isinstance(wanted, Mapping):
            one = value.present()
            for name, operand in wanted.items():
                if (test := value.operator(name, operand)) is not None:
                    one = one & F.coalesce(test, F.lit(False))
        else:
            one = value.present() & value.equals(wanted)
        out = out & F.coalesce(one, F.lit(False))
    return out


def exact_filter(criteria: Mapping[str, Any] | None, metadata: Column | str = "metadata") -> Column:
    """Equality alone; a missing key matches only a wanted None."""
    column = F.col(metadata) if isinstance(metadata, str) else metadata
    out = F.lit(True)
    for key, wanted in (criteria or {}).items():
        value = _Value(column, key)
        out = out & (~value.present() | F.coalesce(value.kind == "VOID", F.lit(False)) if wanted is None else F.coalesce(value.present() & value.equals(wanted), F.lit(False)))
    return out
