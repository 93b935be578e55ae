"""Scalar functions: over columns, and over bytes in numpy."""
