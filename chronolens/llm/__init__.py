"""Operators for large training-data pipelines.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; the queries that apply them to the stock tables are in
:mod:`chronolens.llm.queries`.
"""
