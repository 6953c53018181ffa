"""Verifiable passage citations at corpus scale, expressed as Spark DataFrame operators."""
