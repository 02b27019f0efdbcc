"""Assays from reads to results, as chains of operators."""
