"""Particle, grid and text analytics as plain Spark DataFrame transformations."""
