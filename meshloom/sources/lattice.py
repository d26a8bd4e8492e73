"""A tetrahedral mesh made from the rows of a table: a cube for each part, six tetrahedra for each cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.mesh import CELL, VERTEX, Mesh
from meshloom.operators.tables import large

#: The first two axes of the walk from a cube's low corner to its high one, for each of its six cells.
WALKS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))


def side_for(cubes: int) -> int:
    """The largest n with n cubed at most ``cubes``."""
    n = 0
    while (n + 1) ** 3 <= cubes:
        n += 1
    return n


def tetrahedra(cubes: DataFrame, n: int) -> DataFrame:
    """(orig_gid, v0..v3, cube) of the lattice with n cubes a side; ``cubes``: (cube)."""
    step = (1, n + 1, (n + 1) ** 2)
    cube = F.col("cube")
    low = cube % n + (F.expr(f"cube div {n}") % n) * (n + 1) + F.expr(f"cube div {n * n}") * (n + 1) ** 2
    cells = [F.struct(F.lit(k).alias("k"), F.lit(step[a]).cast("long").alias("s1"), F.lit(step[a] + step[b]).cast("long").alias("s2")) for k, (a, b) in enumerate(WALKS)]
    rows = cubes.where(cube < n**3).select("cube", low.cast("long").alias("v0"), F.explode(F.array(*cells)).alias("t"))
    return rows.select((cube * 6 + F.col("t.k")).alias("orig_gid"), "v0", (F.col("v0") + F.col("t.s1")).alias("v1"), (F.col("v0") + F.col("t.s2")).alias("v2"), (F.col("v0") + sum(step)).alias("v3"), "cube")


def points(spark: SparkSession, n: int) -> DataFrame:
    """(vid, x, y, z) of the lattice's vertices."""
    vid = F.col("id")
    return spark.range((n + 1) ** 3).select(vid.alias("vid"), (vid % (n + 1)).cast("double").alias("x"), (F.floor(vid / (n + 1)) % (n + 1)).cast("double").alias("y"), F.floor(vid / (n + 1) ** 2).cast("double").alias("z"))


def lattice(spark: SparkSession, n: int) -> Mesh:
    """The lattice with n cubes a side."""
    return Mesh(tetrahedra(spark.range(n**3).select(F.col("id").alias("cube")), n), points(spark, n), cell_count=6 * n**3)


def scrambled(parts: int) -> F.Column:
    """A partition of the lattice's cells that puts neighbours apart."""
    return F.pmod(F.col("orig_gid") * 7919 + F.expr("orig_gid div 37"), F.lit(parts)).cast("int")


def table_mesh(spark: SparkSession, sf_dir: str, parts: int = 1) -> Mesh:
    """The lattice with as many cubes as fit the rows of ``part``, in scrambled parts.

    Cell attributes: group (p_size of the cube), price (o_totalprice); vertex attribute: value of the event.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = side_for(part.count())
    cubes = part.select(F.col("p_partkey").alias("cube"), F.col("p_size"))
    cells = tetrahedra(cubes.select("cube"), n)
    mesh = Mesh(cells.drop("cube"), points(spark, n), cell_count=6 * n**3)
    group = large(cells.select("orig_gid", "cube")).join(cubes, "cube").select("orig_gid", F.col("p_size").alias("value"))
    price = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderkey") < 6 * n**3).select(F.col("o_orderkey").alias("orig_gid"), F.col("o_totalprice").alias("value"))
    event = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") < (n + 1) ** 3).select(F.col("event_id").alias("vid"), "value")
    mesh = mesh.add_data(group, CELL).add_data(price, CELL).add_data(event, VERTEX)
    return mesh.partition_by(scrambled(parts), parts) if parts > 1 else mesh
