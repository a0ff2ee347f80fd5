"""Training-data operators on tables of documents and vectors.

Every operator takes DataFrames and returns DataFrames; ``queries`` applies each one to
its whole table. Nothing else in the library imports this package.
"""
