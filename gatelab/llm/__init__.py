"""Operators for preparing language-model training data.

Each module holds one operator with a general interface on DataFrames; `queries`
registers one `opN_<name>` query per operator.  Nothing outside this subpackage
imports it.
"""
