"""Operators for preparing large text collections for language-model training.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and column names, selects the columns it needs (other columns of
the input, whatever their names, are ignored) and returns a DataFrame.
"""
