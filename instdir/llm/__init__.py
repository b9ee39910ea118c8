"""Operators for large text corpora: archives, packing, decontamination, dedup, media, filters, scans.

Nothing else in the library imports this subpackage, but ``operators.terms`` the guarded joins of ``common``; queries and SQL are in ``llm.queries``.
"""
