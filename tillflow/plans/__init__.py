"""Retail pipelines composed from the operators."""
