"""Credential-exposure analytics expressed as Spark dataflow."""
