"""Catalogs, samples, guarded reads and result tables."""
