"""Operators for building training corpora: filtering, deduplication, packing,
sharding, archiving, extraction, scoring and tokenisation.

Nothing else in the library imports this subpackage.  Every operator takes the
names of its key and text columns, ignores other columns (whatever their
names) and documents what null keys, null texts, ties, repeated rows and empty
tables give.
"""
