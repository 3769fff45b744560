"""Training-data operators: search, formatting, filtering, scoring, mixing and packing.

Nothing outside this subpackage imports it.
"""
