"""Symbolic sequence archive, search and vector quantization as PySpark DataFrame plans."""
