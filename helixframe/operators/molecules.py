"""Atoms and trajectories: formula, masses, distances, bonds, deviations of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Atomic masses and covalent radii.
MASS = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "P": 30.974, "S": 32.06, "F": 18.998, "CL": 35.45, "BR": 79.904, "I": 126.904}
RADIUS = {"H": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "P": 1.07, "S": 1.05, "F": 0.57, "CL": 1.02, "BR": 1.20, "I": 1.39}


def _of(element, values: dict[str, float], otherwise: float) -> Column:
    pairs = F.create_map(*(F.lit(x) for p in values.items() for x in p))
    return F.coalesce(F.try_element_at(pairs, F.upper(element)), F.lit(otherwise))


def formula(atoms: DataFrame, key: str = "molecule") -> DataFrame:
    """(key, formula) in Hill order: carbon, hydrogen, then the rest by name."""
    n = atoms.groupBy(key, F.initcap("element").alias("e")).agg(F.count("*").alias("n"))
    rank = F.when(F.col("e") == "C", 0).when(F.col("e") == "H", 1).otherwise(2)
    part = F.concat(F.col("e"), F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(""))
    return n.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "e", part.alias("p")))), lambda x: x["p"]), "").alias("formula"))


def center_of_mass(atoms: DataFrame, *keys: str) -> DataFrame:
    m = _of(F.col("element"), MASS, 12.0)
    return atoms.groupBy(*keys).agg(*((F.sum(m * F.col(c)) / F.sum(m)).alias(c) for c in "xyz"), F.sum(m).alias("mass"))


def _distance(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "xyz"), F.lit(0.0)))


def distances(atoms: DataFrame, key: str = "molecule") -> DataFrame:
    """(key, i, j, distance) of atom pairs i < j of each molecule."""
    return atoms.alias("a").join(atoms.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.serial") < F.col("b.serial"))).select(F.col(f"a.{key}").alias(key), F.col("a.serial").alias("i"), F.col("b.serial").alias("j"), _distance("a", "b").alias("distance"))


def bonds(atoms: DataFrame, key: str = "molecule", tolerance: float = 0.4, cell: float = 4.0) -> DataFrame:
    """(key, i, j, distance) of pairs no further apart than their radii and the tolerance. Atoms meet in cells of space, not all with all."""
    rows = atoms.withColumn("r", _of(F.col("element"), RADIUS, 0.77))
    near = F.sequence(F.lit(-1), F.lit(1))
    own = [F.floor(F.col(c) / cell).cast("long").alias(f"c{c}") for c in "xyz"]
    a = rows.select("*", *own)
    b = a
    for c in "xyz":
        b = b.withColumn("__d", F.explode(near)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("__d")).drop("__d")
    met = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.cz") == F.col("b.cz")) & (F.col("a.serial") < F.col("b.serial"))
    pairs = a.alias("a").join(b.alias("b"), met).withColumn("distance", _distance("a", "b"))
    return pairs.where(F.col("distance") <= F.col("a.r") + F.col("b.r") + tolerance).select(F.col(f"a.{key}").alias(key), F.col("a.serial").alias("i"), F.col("b.serial").alias("j"), "distance")


# --- trajectories: (frame, atom, x, y, z) -----------------------------------------------------------------------------


def rmsd(frames: DataFrame, reference: DataFrame) -> DataFrame:
    """(frame, rmsd) to reference positions (atom, x, y, z), both centred, not turned."""
    def centred(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.select(*keys, "atom", *((F.col(c) - F.avg(c).over(w)).alias(c) for c in "xyz"))

    ref = centred(reference).select("atom", *(F.col(c).alias(f"r{c}") for c in "xyz"))
    d = sum(((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in "xyz"), F.lit(0.0))
    return centred(frames, "frame").join(ref, "atom").groupBy("frame").agg(F.sqrt(F.avg(d)).alias("rmsd"))


def rmsf(frames: DataFrame) -> DataFrame:
    """(atom, rmsf): fluctuation about each atom's mean position."""
    return frames.groupBy("atom").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def radius_of_gyration(frames: DataFrame) -> DataFrame:
    """(frame, radius) about the plain centroid."""
    return frames.groupBy("frame").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("radius"))


def atom_distance(frames: DataFrame, one: int, other: int) -> DataFrame:
    """(frame, distance) of two atoms."""
    pick = lambda i, c: F.max(F.when(F.col("atom") == i, F.col(c)))
    d = sum((F.pow(pick(one, c) - pick(other, c), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    return frames.where(F.col("atom").isin(one, other)).groupBy("frame").agg(F.sqrt(d).alias("distance"))


def energy_statistics(frames: DataFrame) -> DataFrame:
    return frames.agg(*(f(c).alias(f"{n}_{c}") for c in ("energy", "temperature") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
