"""Tessera: archive analytics and training-data operators on PySpark."""
