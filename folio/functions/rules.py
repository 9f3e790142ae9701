"""Strict input rules as reason codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.text import UUID


def validate_rows(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """df with ``reasons``, codes column:rule in the order of the rules; empty where a row is valid.

    Rules of a column: required (not null), enum (values), length (least, most), range (least, most), uuid, pattern. A null breaks only ``required``.
    """
    codes: list[Column] = []
    for name, own in rules.items():
        c = F.col(name)
        broken = {
            "required": c.isNull(), "enum": ~c.isin(*own.get("enum", [""])), "uuid": ~F.lower(c.cast("string")).rlike(UUID),
            "pattern": ~c.cast("string").rlike(own.get("pattern", "")),
        }
        for rule, wanted in own.items():
            if rule == "length":
                bad = ~F.length(c).between(*wanted)
            elif rule == "range":
                bad = ~c.between(*wanted)
            else:
                bad = broken[rule]
            codes.append(F.when(bad, f"{name}:{rule}"))
    return df.withColumn("reasons", F.array_compact(F.array(*codes)) if codes else F.array().cast("array<string>"))
