"""cairn: point-cloud analytics as Spark DataFrame operators.

Points live in DataFrames keyed by ``tile`` and ``point_id``; every operator is a function from DataFrames to
DataFrames.
"""
