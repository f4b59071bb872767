"""Issuer-evidence analytics expressed as Spark plans."""
