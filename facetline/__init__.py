"""Ranked similarity search over typed feature columns, as Spark plans."""
