"""Extractors: lines in, one typed table per domain out.

Each one filters with cheap substring tests first, runs a regex only on what is left and orders
only those rows.
"""
