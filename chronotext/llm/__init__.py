"""Operators for preparing language-model training data.

Each module holds one operator; nothing outside this subpackage imports it.
"""
