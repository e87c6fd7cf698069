"""Training-data operators: thirteen corpus jobs and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
