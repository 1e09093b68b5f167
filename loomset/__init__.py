"""Preparation and audit of captioned training datasets as Spark plans."""
