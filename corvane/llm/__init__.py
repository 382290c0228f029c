"""Operators for preparing training data. Nothing outside this subpackage imports it."""

#: Modules with ``queries()`` and ``oracle_sql()``.
MODULES = ("leaks", "names", "packing", "split", "subjects", "transcripts", "vectors")
