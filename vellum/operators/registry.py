"""Model registry tables: immutable versions, the current pointer, promotion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class GateRefused(RuntimeError):
    """A version whose gate did not pass is not promoted without force."""


def metadata(gate: str, training: str) -> Column:
    """Fields from the gate, else from the training record; empty strings count as missing."""
    pick = lambda f: F.coalesce(F.nullif(F.col(f"{gate}.{f}"), F.lit("")), F.nullif(F.col(f"{training}.{f}"), F.lit("")))
    return F.struct(*[pick(f).alias(f) for f in ("base_model", "dataset_version")])


def trimmed(values: Column, most: int = 2000) -> Column:
    """A map of JSON values without the long ones."""
    return F.map_filter(values, lambda k, v: F.octet_length(v) <= most)


def given(options: Column) -> Column:
    """Only the options that are set."""
    return F.map_filter(options, lambda k, v: v.isNotNull())


def registered(versions: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new versions; a version that exists is never replaced."""
    if (row := new.join(versions, ["name", "version"], "left_semi").first()) is not None:
        raise ValueError(f"{row['name']}@{row['version']} exists already")
    if (row := new.where(~F.col("name").rlike(f"^{_NAME.pattern}$")).first()) is not None:
        raise ValueError(f"not a registry name: {row['name']}")
    return versions.unionByName(new)


def promoted(current: DataFrame, versions: DataFrame, name: str, version: str, now: str, by: str = "cli", force: bool = False) -> DataFrame:
    """The current pointers with one moved; refused unless the version's gate passed or `force`."""
    row = versions.where((F.col("name") == name) & (F.col("version") == version)).first()
    if row is None:
        raise ValueError(f"no {name}@{version}")
    if row.passed is not True and not force:
        raise GateRefused(f"the gate of {name}@{version} did not pass")
    new = versions.sparkSession.createDataFrame([(name, version, now, by, row.passed is not True)], "name string, version string, promoted_at string, promoted_by string, forced boolean")
    return current.where(F.col("name") != name).unionByName(new)


def listing(versions: DataFrame, current: DataFrame) -> DataFrame:
    """Names with their versions, oldest first, and the current one."""
    held = versions.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("created_at", "version"))).alias("v"))
    return held.select("name", F.transform("v", lambda x: x["version"]).alias("versions")).join(current.select("name", F.col("version").alias("current")), "name", "left")


def detail(versions: DataFrame, current: DataFrame, name: str, version: str | None = None) -> DataFrame:
    """Rows of a name's version, by default the current one."""
    rows = versions.where(F.col("name") == name)
    return rows.where(F.col("version") == version) if version else rows.join(current.select("name", "version"), ["name", "version"], "left_semi")


def resolved(specs: DataFrame, current: DataFrame) -> DataFrame:
    """spec, name, version and label; registry:name[@version] takes the current version if none is given, others pass."""
    is_spec = F.col("spec").startswith("registry:")
    body = F.regexp_extract("spec", "^registry:(.*)$", 1)
    name, wanted = F.split_part(body, F.lit("@"), F.lit(1)), F.nullif(F.split_part(body, F.lit("@"), F.lit(2)), F.lit(""))
    rows = specs.select("spec", F.when(is_spec, name).alias("name"), F.when(is_spec, wanted).alias("wanted"))
    out = rows.join(current.select("name", F.col("version").alias("_now")), "name", "left").withColumn("version", F.coalesce("wanted", "_now"))
    return out.select("spec", "name", "version", F.when(F.col("name").isNull(), F.col("spec")).when(F.col("version").isNotNull(), F.concat_ws("@", "name", "version")).alias("label"))
