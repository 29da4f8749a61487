"""Retail operations analytics as lazily composed Spark DataFrame operators.

Every operator takes a ``dict`` of DataFrames keyed by table name and returns
a DataFrame; nothing runs until the caller asks for an action.
"""
