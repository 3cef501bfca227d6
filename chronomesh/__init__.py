"""Spatio-temporal property-graph analytics expressed as Spark DataFrame plans."""
