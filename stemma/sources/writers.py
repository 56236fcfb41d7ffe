"""Sinks (SNK-01..12): idempotent writes of whole partitions, first-wins and last-wins merges, reports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """SNK-01: replace the partitions that df has, and no others: a rerun leaves the same table."""
    df.repartition(*by).sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """SNK-02: existing rows, and the first new row of each key that they lack."""
    first = new.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
    return existing.unionByName(first.join(existing.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def insert_or_replace(existing: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """SNK-03: the last new row of each key, and the existing rows of other keys."""
    last = new.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(F.col(seq).desc()))).where("_rn = 1").drop("_rn")
    return last.unionByName(existing.join(last.select(*key), key, "left_anti"), allowMissingColumns=True)


def append(df: DataFrame, path: str) -> None:
    """SNK-04."""
    df.write.mode("append").parquet(path)


def update(df: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """SNK-05: df with the values of changes where a key matches; nulls in changes leave the old value."""
    new = [c for c in changes.columns if c not in key]
    joined = df.join(changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in new]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in df.columns])


def sql_literal(value) -> str:
    """SNK-07."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    return repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def insert_statements(df: DataFrame, table: str, rows: int = 500, size: int = 80_000) -> DataFrame:
    """SNK-06: INSERT statements of at most so many rows and bytes (or one row), made in each partition apart; column: statement."""
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES "

    def run(batches):
        import pandas as pd

        held, used = [], 0
        for pdf in batches:
            out = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                text = "(" + ",".join(sql_literal(getattr(v, "item", lambda v=v: v)()) for v in row) + ")"
                n = len(text.encode()) + 1
                if held and (len(held) == rows or len(head) + used + n > size):
                    out.append(head + ",".join(held) + ";")
                    held, used = [], 0
                held.append(text)
                used += n
            yield pd.DataFrame({"statement": out})
        if held:
            yield pd.DataFrame({"statement": [head + ",".join(held) + ";"]})

    return df.mapInPandas(run, "statement string")


def write_tsv(df: DataFrame, path: str) -> None:
    """SNK-08."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def log_phase(spark: SparkSession, path: str, phase: str, count: int, seconds: float) -> None:
    """SNK-09: one row of metrics."""
    spark.sql("SELECT current_timestamp() AS timestamp").select("timestamp", F.lit(phase).alias("phase"), F.lit(count).cast("long").alias("count"), F.lit(float(seconds)).alias("seconds")).write.mode("append").parquet(path)


def analyze(spark: SparkSession, table: str) -> None:
    """SNK-10: statistics for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def schema_json(df: DataFrame) -> str:
    """SNK-11."""
    return df.schema.json()


def to_json(df: DataFrame) -> DataFrame:
    """SNK-12: one JSON text for each row; column: value."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
