"""Absorbance-kinetics analytics as Spark DataFrame operators."""
