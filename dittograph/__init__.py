"""Duplicate and similarity analytics expressed as lazy Spark DataFrame plans."""
