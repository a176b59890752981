"""Operators over transaction tables; each takes and gives lazy DataFrames."""
