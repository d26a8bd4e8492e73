"""Even block distribution of entities over parts, as numbers and as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Blocks:
    """``entities`` in ``parts`` blocks; the first entities % parts blocks have one more. Fewer entities than parts are fine."""

    entities: int
    parts: int

    def __post_init__(self) -> None:
        if self.parts < 1 or self.entities < 0:
            raise ValueError("a distribution needs a part and no negative number of entities")

    def offset_and_size(self, part: int) -> tuple[int, int]:
        if not 0 <= part < self.parts:
            raise ValueError(f"part {part} is outside 0..{self.parts - 1}")
        quotient, rest = divmod(self.entities, self.parts)
        return part * quotient + min(part, rest), quotient + (part < rest)

    def part_of(self, gid: int) -> int:
        if not 0 <= gid < self.entities:
            raise ValueError(f"entity {gid} is outside 0..{self.entities - 1}")
        quotient, rest = divmod(self.entities, self.parts)
        wide = rest * (quotient + 1)
        return gid // (quotient + 1) if gid < wide else rest + (gid - wide) // quotient

    def local_id(self, part: int, gid: int) -> int:
        return gid - self.offset_and_size(part)[0]

    def part_column(self, gid: Column) -> Column:
        """The part of each entity."""
        quotient, rest = divmod(self.entities, self.parts)
        wide = rest * (quotient + 1)
        first = F.floor(gid / (quotient + 1))
        if quotient == 0:
            return first.cast("int")
        return F.when(gid < wide, first).otherwise(rest + F.floor((gid - wide) / quotient)).cast("int")

    def offset_column(self, part: Column) -> Column:
        quotient, rest = divmod(self.entities, self.parts)
        return (part * quotient + F.least(part, F.lit(rest))).cast("long")

    def size_column(self, part: Column) -> Column:
        quotient, rest = divmod(self.entities, self.parts)
        return (F.lit(quotient) + F.when(part < rest, 1).otherwise(0)).cast("long")

    def table(self, spark: SparkSession) -> DataFrame:
        """(part, offset, size), a row for each part."""
        part = F.col("id")
        return spark.range(self.parts).select(part.cast("int").alias("part"), self.offset_column(part).alias("offset"), self.size_column(part).alias("size"))
