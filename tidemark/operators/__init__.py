"""Operators over the review stream: windows, joins, metrics, splits, learners and checks."""
