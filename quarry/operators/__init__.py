"""Relational and extraction operators."""
