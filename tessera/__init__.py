"""Tessera: a PySpark-native data-contract and corpus-preparation engine."""
