"""Tables by name, feature assembly, long-form sparse rows, and saved models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Comma-separated doubles without a header, as columns c0, c1, ... or ``names``."""
    df = spark.read.csv(path)
    names = list(names or [f"c{i}" for i in range(len(df.columns))])
    return df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(df.columns, names)])


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """The features as one array column; a NULL among them raises when rows are read."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    bad = F.exists(x, lambda v: v.isNull())
    return df.withColumn(out, F.when(bad, F.raise_error(F.lit("NULL feature")).cast("array<double>")).otherwise(x))


def to_long(df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """(row_id, feature_idx, value) of the values that aren't zero."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return df.select(F.col(id_col).alias("row_id"), F.posexplode(x).alias("feature_idx", "value")).filter("value <> 0")


def save_model(model, spark: SparkSession, path: str) -> None:
    """Class, parameters and everything fitted as a Parquet table of (name, value)."""
    import base64
    import pickle

    blob = base64.b64encode(pickle.dumps({k: v for k, v in model.__dict__.items() if not k.startswith("_index")})).decode()
    rows = [("class", f"{type(model).__module__}:{type(model).__qualname__}"), ("state", blob), *model.to_rows()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    """A saved model.  The table holds a pickle: read only what you have written."""
    import base64
    import importlib
    import pickle

    rows = {r["name"]: r["value"] for r in spark.read.parquet(path).filter("name IN ('class', 'state')").collect()}
    module, _, name = rows["class"].partition(":")
    if not module.startswith("millrace."):
        raise ValueError("not a saved model")
    model = getattr(importlib.import_module(module), name)()
    model.__dict__.update(pickle.loads(base64.b64decode(rows["state"])))
    return model
