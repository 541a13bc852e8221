"""Readers and writers: archive files, the event dataset, the ledger, result tables."""
