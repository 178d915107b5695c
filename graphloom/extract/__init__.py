"""Extractors: what files declare, import and register with frameworks."""
