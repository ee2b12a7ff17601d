"""Uncertainty-evaluation analytics on Spark: question sets, signals, labels, metrics, resampling, audits."""
