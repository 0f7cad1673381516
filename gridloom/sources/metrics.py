"""Where a run's figures go: rows (run, iter, name, value), appended as Parquet and never printed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, iter long, name string, value double"


@dataclass(frozen=True)
class MetricsSink:
    """Appends to a folder that any store may hold; every append is a job of its own, so what was written stays when a run ends early."""

    spark: SparkSession
    path: str
    run: str

    def append(self, step: int, figures: dict[str, float]) -> None:
        rows = [(self.run, step, name, None if value is None else float(value)) for name, value in figures.items()]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def append_table(self, step: int, figures: DataFrame, prefix: str = "") -> None:
        """Every numeric column of a table of one row as a figure."""
        names = [f.name for f in figures.schema if f.dataType.simpleString() not in ("string", "boolean")]
        pairs = F.explode(F.array(*(F.struct(F.lit(prefix + n).alias("name"), F.col(n).cast("double").alias("value")) for n in names)))
        rows = figures.select(F.lit(self.run).alias("run"), F.lit(step).cast("long").alias("iter"), pairs.alias("p")).select("run", "iter", "p.name", "p.value")
        rows.write.mode("append").parquet(self.path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(run, iter, a column per name): what a report shows of each step; the last value counts where a name was given twice."""
    picked = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    return metrics.where(F.col("name").isin(names)).groupBy("run", "iter").agg(*picked)


def timings(metrics: DataFrame, name: str) -> DataFrame:
    """(run, n, least, median) of one figure, such as the seconds of repeated decodes."""
    return metrics.where(F.col("name") == name).groupBy("run").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.percentile("value", 0.5).alias("median"))
