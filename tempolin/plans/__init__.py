"""Declarations of models, and a library of them."""
