"""Scalar functions of the normalisation library, as column expressions."""
