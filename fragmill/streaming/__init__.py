"""Stateless encoding and windowed fragment counts on streams."""
