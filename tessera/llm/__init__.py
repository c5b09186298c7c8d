"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to DataFrames; ``queries`` registers the thin
``opN_<name>`` queries over the driver's tables.
"""
