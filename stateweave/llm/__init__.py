"""Operators for building text corpora: tokenizing, de-duplication, scans, search, scoring, mixing and filtering.

Each module holds one operator with a general interface.  ``queries`` applies them to the shared tables.
Nothing outside this package imports it.
"""
