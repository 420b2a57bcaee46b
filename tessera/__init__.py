"""Tessera: document and metric analytics as Spark plans."""
