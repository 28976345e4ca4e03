"""Scalar ``Column`` builders (``columns``) and row predicates (``predicates``)."""
