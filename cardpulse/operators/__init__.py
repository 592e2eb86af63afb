"""Relational operators of the transaction pipeline and of alert evaluation."""
