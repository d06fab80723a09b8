"""The pipelines."""
