"""Operators of a large-scale training-data pipeline.

Each module holds one operator with a general interface; ``queries`` registers
the thin ``opN_<name>`` queries and their SQL.  Nothing outside this subpackage
imports it.
"""
