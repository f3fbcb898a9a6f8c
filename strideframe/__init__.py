"""strideframe: record-table operators and a goal-model feature/train/score
workflow for activity logs, built on Spark DataFrames and pyspark.ml."""

__version__ = "0.1.0"
