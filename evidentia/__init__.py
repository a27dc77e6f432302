"""Spark-first operators for curating evidence tables, deriving leak-free datasets and scoring model outputs."""
