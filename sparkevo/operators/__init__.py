"""Operators: DataFrame in, DataFrame out; random draws are columns made from hashes."""
