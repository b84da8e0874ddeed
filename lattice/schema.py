"""Schemas and ordered vocabularies of the fact base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATION = "struct<path:string,line_start:int,line_end:int,kind:string>"
EDGE = f"`from` string, `to` string, type string, evidence string, strength string, locations array<{LOCATION}>"
FILE = "rel string, ext string, size long, language string, indexed_boundary string, content_hash string, line_count int, roles array<string>"
SYMBOL = "rel string, name string, kind string, exported boolean, line_start int, line_end int, ordinal int"
UNKNOWN = "kind string, path string, line_start int, reason string, effect string"

#: Ordered from weakest.
STRENGTHS = ("low", "medium", "high", "hard")
RISKS = ("low", "medium", "medium-high", "high", "critical")


def rank_of(column: Column, names: tuple[str, ...]) -> Column:
    """The place of a name in an ordered vocabulary, from 0; -1 for any other."""
    out = F.lit(-1)
    for k, name in enumerate(names):
        out = F.when(column == name, k).otherwise(out)
    return out


def name_of(rank: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), rank + 1)
