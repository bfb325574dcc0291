"""Operators for preparing large text collections for model training.

Nothing outside this subpackage imports it.  Operators live in one module each;
``queries`` registers the thin contract queries on the standard tables.
"""
