"""Operators for preparing training data, each a function over DataFrames.

See the modules; :mod:`.catalog` registers the queries over the test tables.
"""
