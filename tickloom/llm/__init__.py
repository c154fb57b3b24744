"""Operators for preparing large text corpora (fingerprints, dedup, mixing, packing, ...).

The subpackage stands alone: nothing else in the library imports it, and it
imports nothing from the rest of the library.
"""
