"""Ledger rounds from a stream of differences."""
