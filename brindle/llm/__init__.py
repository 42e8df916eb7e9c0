"""Operators of a training-data pipeline: quality, licences, decontamination, near-duplicates,
token files, mixing, line dedup and chat formatting.  Nothing else in the library imports this
subpackage."""
