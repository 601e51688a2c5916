"""Chronoloom: longitudinal observation analytics expressed as Spark plans."""
