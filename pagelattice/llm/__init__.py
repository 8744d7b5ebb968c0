"""Training-data operators: de-duplication, packing, extraction, scoring, tokenisation.

Nothing outside this subpackage imports it.
"""
