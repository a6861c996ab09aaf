"""Training-data operators: language ID, mixing, BPE, token counts, near-duplicates, scans and quality rules.

Nothing outside this subpackage imports it.
"""
