"""Operators for pipelines that prepare training text."""
