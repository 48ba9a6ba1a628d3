"""Operators of a training-data pipeline; nothing else in the package imports this folder.

Each module holds one operator with its own interface; ``queries`` holds the registered
queries, which call the operators with production parameters.
"""
