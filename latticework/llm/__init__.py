"""Corpus operators for preparing training text.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns DataFrames; the names of the id and
text columns are parameters, all other input columns are ignored, so extra columns and clashing names do no harm.
"""
