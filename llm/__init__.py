"""Operators of a training-data pipeline: ten corpus operators, their queries and their oracles.

Nothing outside this folder imports it.
"""
