"""Terrain and trail-evidence analytics expressed as Spark DataFrame operators."""
