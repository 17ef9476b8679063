"""Scalar functions: the molecule kernel and its Column API."""
