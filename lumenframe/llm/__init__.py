"""Operators for large text corpora: archives, filters, joins, packing and scoring.

Nothing outside this folder imports it; the driver entry adds its queries when
the import succeeds.
"""
