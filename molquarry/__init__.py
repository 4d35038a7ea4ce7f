"""Molecular-structure pattern analytics as Spark DataFrame plans."""
