"""Training-data operators: packing, language ID, near-duplicates, extraction, decontamination, scoring.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
