"""The nine relations as Parquet tables: load, go on loading, refresh, snapshot, restore.

A relation is made of one or more parts, and a version of the warehouse names the parts of all
relations (see ``versions``): whatever is written takes effect at once, or not at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.operators.aggregates import GRAINS, agg_all
from txnlens.operators.star import DIMENSIONS, Star, extend_star
from txnlens.schemas import RELATIONS
from txnlens.sources import versions
from txnlens.sources.versions import Version

AGGREGATES = {grain: f"agg_{grain}_fraud" for grain in GRAINS}
STAR_RELATIONS = (*(f"dim_{name}" for name in DIMENSIONS), "fact_transactions")
_PARTITIONS = ("year", "month")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a relation in their fixed order and types; overflow raises."""
    spark_schema = df.sparkSession.createDataFrame([], RELATIONS[name]).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spark_schema.fields])


def _write_part(df: DataFrame, path: str, name: str, rebalance: bool) -> None:
    out = conform(df, name)
    if name != "fact_transactions":
        out.write.parquet(path)
        return
    if rebalance:
        out = out.hint("rebalance", *_PARTITIONS)
    out.write.partitionBy(*_PARTITIONS).parquet(path)


def publish(
    tables: Mapping[str, DataFrame], root: str, mode: str = "overwrite", rebalance: bool = True, base: Version | None = None, info: dict | None = None
) -> Version:
    """Write relations as new parts, then make them count together: instead of the old parts
    (``overwrite``) or with them (``append``).

    The fact is split by month. ``rebalance`` moves the rows of a month together, a heavy month still
    into several tasks, so that few large files result; rows that come in the order of time need no
    such shuffle. If the version has changed since ``base``, nothing takes effect.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode: {mode}")
    spark = next(iter(tables.values())).sparkSession
    base = versions.current(spark, root) if base is None else base
    parts = {}
    for name, df in tables.items():
        part = versions.new_part(name)
        _write_part(df, f"{root.rstrip('/')}/{part}", name, rebalance)
        parts[name] = [*(base.parts.get(name, []) if mode == "append" else []), part]
    return versions.switch(spark, root, base, parts, info)


def write_relation(df: DataFrame, root: str, name: str, mode: str = "overwrite", rebalance: bool = True) -> None:
    """Write one relation, see ``publish``."""
    publish({name: df}, root, mode, rebalance)


def read_relation(spark: SparkSession, root: str, name: str, version: Version | None = None) -> DataFrame:
    """Read one relation with its fixed schema (no inference, columns in order)."""
    schema = spark.createDataFrame([], RELATIONS[name]).schema
    paths = (versions.current(spark, root) if version is None else version).paths(root, name)
    if not paths:
        raise ValueError(f"no relation {name} under {root}")
    parts = [spark.read.schema(schema).parquet(path).select(*schema.names) for path in paths]
    return reduce(DataFrame.unionByName, parts)


def save_star(star: Star, root: str, rebalance: bool = True) -> None:
    """Replace dimensions and fact. Rows are added by ``append_transactions``, which goes on with the keys."""
    publish({**{f"dim_{name}": star.dim(name) for name in DIMENSIONS}, "fact_transactions": star.fact}, root, rebalance=rebalance)


def load_star(spark: SparkSession, root: str, version: Version | None = None) -> Star:
    version = versions.current(spark, root) if version is None else version
    dims = {name: read_relation(spark, root, f"dim_{name}", version) for name in DIMENSIONS}
    return Star(**dims, fact=read_relation(spark, root, "fact_transactions", version))


def append_transactions(txn: DataFrame, root: str, ord: str | Sequence[str] = "ord", rebalance: bool = True) -> Star:
    """Add typed transactions to a stored star and return the rows added.

    Keys known to the star keep their ids, new ones get the next; transactions are numbered on. The
    additions count once all of them are written; if the star changes meanwhile, none do.
    """
    spark = txn.sparkSession
    base = versions.current(spark, root)
    added = extend_star(load_star(spark, root, base), txn, ord)
    tables = {**{f"dim_{name}": added.dim(name) for name in DIMENSIONS}, "fact_transactions": added.fact}
    publish(tables, root, "append", rebalance, base)
    return added


def refresh_aggregates(star: Star, root: str) -> None:
    """Rebuild all four aggregates from one pass over the fact; they are replaced together."""
    publish({AGGREGATES[grain]: df for grain, df in agg_all(star).items()}, root)


def load_aggregates(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    version = versions.current(spark, root)
    return {grain: read_relation(spark, root, name, version) for grain, name in AGGREGATES.items()}


def relations(star: Star, aggregates: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All nine relations by name."""
    out = {f"dim_{name}": star.dim(name) for name in DIMENSIONS}
    out["fact_transactions"] = star.fact
    out.update({AGGREGATES[grain]: df for grain, df in aggregates.items()})
    return out


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def export_snapshot(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write all relations as one version, and then a manifest with the number of rows of each."""
    missing = set(RELATIONS) - set(tables)
    if missing:
        raise ValueError(f"relations missing: {sorted(missing)}")
    spark = next(iter(tables.values())).sparkSession
    written = publish({name: tables[name] for name in RELATIONS}, path)
    versions.switch(spark, path, written, {}, {"rows": counts(spark, path, written)})


def restore_snapshot(spark: SparkSession, path: str, root: str) -> dict[str, DataFrame]:
    """Check a snapshot against its manifest, replace all relations under ``root`` at once, register views."""
    version = versions.current(spark, path)
    manifest, found = version.info.get("rows"), counts(spark, path, version)
    if manifest != found:
        bad = sorted(name for name in RELATIONS if (manifest or {}).get(name) != found[name])
        raise ValueError(f"snapshot differs from its manifest: {bad}")
    restored = publish({name: read_relation(spark, path, name, version) for name in RELATIONS}, root)
    tables = {name: read_relation(spark, root, name, restored) for name in RELATIONS}
    register_views(tables)
    return tables


def counts(spark: SparkSession, path: str, version: Version | None = None) -> dict[str, int]:
    """Number of rows of each relation, from one job."""
    version = versions.current(spark, path) if version is None else version
    rows = [
        read_relation(spark, path, name, version).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        for name in RELATIONS
    ]
    return {r["relation"]: r["n"] for r in reduce(DataFrame.unionByName, rows).collect()}
