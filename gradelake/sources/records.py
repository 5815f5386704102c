"""Extraction records of model replies under a profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gradelake.functions.replies import salvaged_json


@dataclass(frozen=True)
class Profile:
    """Name, answer fields in order, and the record schema they imply."""

    name: str
    answer_fields: tuple[str, ...]

    @property
    def fields(self) -> list[str]:
        names = ["student_name", "student_name_confidence"]
        for f in self.answer_fields:
            names += [f, f"{f}_confidence"]
        return [*names, "confidence"]

    @property
    def schema(self) -> StructType:
        return StructType([StructField(f, StringType()) for f in self.fields])


_PROFILES: dict[str, Profile] = {}


def register(profile: Profile) -> Profile:
    _PROFILES[profile.name] = profile
    return profile


def get(name: str) -> Profile:
    if name not in _PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(sorted(_PROFILES))}")
    return _PROFILES[name]


# The multiple choice sheet with six answers on two sides.
SPACE_UNIT = register(Profile("igcse_physics", ("q38_left_top", "q39_left", "q40_left", "q38_left_bottom", "q39_right", "q40_right")))


def read_records(df: DataFrame, profile: Profile, raw: str = "raw") -> DataFrame:
    """Columns of the profile from raw replies; other fields of a reply are dropped.

    ``parsed`` tells whether the reply was usable.
    """
    text = salvaged_json(F.col(raw))
    df = df.withColumn("_t", text).withColumn("parsed", F.col("_t").isNotNull() & F.ltrim("_t").startswith("{"))
    record = F.from_json(F.when(F.col("parsed"), F.col("_t")), profile.schema)
    return df.withColumn("_r", record).select(*[c for c in df.columns if c not in ("_t", "parsed", raw)], "parsed", "_r.*")
