"""Readers, writers, catalogs and the adapters of the test tables."""
