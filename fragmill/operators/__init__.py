"""Relational operators on molecules, fragments and tokens."""
