"""Listing and price analytics as Spark DataFrame operators."""
