"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; ``registry`` lists the
queries and the SQL they are compared with.
"""
