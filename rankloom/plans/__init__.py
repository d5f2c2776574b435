"""Whole experiments, composed from operators. All of them stay lazy unless they store."""
