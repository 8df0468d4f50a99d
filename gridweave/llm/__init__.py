"""Operations of a training-data pipeline: scans, filters, dedup, search, mixing, tokens.

Nothing else in the library imports this subpackage.
"""
