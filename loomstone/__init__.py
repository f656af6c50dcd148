"""Loomstone: an analytics engine whose operators are lazy DataFrame and Column functions."""

__version__ = "0.1.0"
