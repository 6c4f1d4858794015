"""Spark-first analytics over labelled game-position datasets and text corpora."""
