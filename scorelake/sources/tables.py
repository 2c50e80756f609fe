"""Tables by name, from Parquet, JSON lines or CSV, and pairs of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header; quoted values may hold line breaks and doubled quotation marks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, prompt, answer: user turns with the assistant turn that follows."""
    turns = parquet(spark, folder, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(answer, ["conv_id", "turn"])
