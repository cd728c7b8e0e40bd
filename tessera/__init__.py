"""Tessera: linear algebra and array analytics expressed as Spark DataFrame plans."""
