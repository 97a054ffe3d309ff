"""Training-data operators: decontamination, packing, archives, filtering, dedup.

Nothing outside this subpackage imports it.  Every operator is a function of
DataFrames; ``queries`` derives the fixed result columns from them.
"""
