"""Training-data operators: residue, repeated lines, frequencies, history
deduplication, cut texts, distinctive terms, packing, mixing and quality.

Nothing outside this package imports it; it uses nothing of the search core.
"""
