"""Operators for training-data pipelines over large text corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; `factloom.llm.queries` registers one query per operator.
"""
