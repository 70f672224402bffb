"""The catalogue of areas and unions of their members' tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Area:
    id: str
    name: str
    uf: str
    municipalities: tuple[int, ...]


#: The published areas, in catalogue order, with the codes of their municipalities.
AREAS = (
    Area("4113700", "Londrina", "PR", (4113700,)),
    Area("4106902", "Curitiba", "PR", (4106902,)),
    Area("4115200", "Maringá", "PR", (4115200,)),
    Area("4205407", "Florianópolis", "SC", (4205407,)),
    Area("5300108", "Brasília", "DF", (5300108,)),
    Area("3550308", "São Paulo", "SP", (3550308,)),
    Area("abc-paulista", "ABC Paulista", "SP", (3547809, 3548708, 3548807, 3513801, 3529401, 3543303, 3544103)),
)


def catalogue(spark: SparkSession, areas: list[Area]) -> DataFrame:
    """(id, name, uf, municipalities, ordinal): a small dimension table in catalogue order."""
    rows = [(a.id, a.name, a.uf, list(a.municipalities), i) for i, a in enumerate(areas)]
    return spark.createDataFrame(rows, "id string, name string, uf string, municipalities array<long>, ordinal int")


def area(areas: list[Area], area_id: str) -> Area:
    found = {a.id: a for a in areas}
    if area_id not in found:
        raise KeyError(f"unknown area {area_id!r}; known are {', '.join(sorted(found))}")
    return found[area_id]


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
