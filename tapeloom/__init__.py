"""Spark-first analytics over market bars, with a subpackage of training-data operators."""
