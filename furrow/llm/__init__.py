"""Training-data operators: dedup, mixing, filters, token counts and LM scores.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; the modules named ``*_query`` hold the thin contract
queries that the driver runs.
"""
