"""Operators for preparing training text at scale: mixing, scans, deduplication, scoring, encoding.

Each module holds one operator as a function ``DataFrame -> DataFrame``; ``queries`` registers
the thin ``opN_*`` queries over them.  Nothing outside this subpackage imports it.
"""
