"""Spark-native code analysis: syntax trees as tables, checkers as relational plans."""

__version__ = "0.1.0"
