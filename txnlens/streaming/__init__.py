"""Streaming versions of the transaction reports."""
