"""Readers, stores and the adapters that view other tables as collections."""
