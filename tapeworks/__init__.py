"""Spark jobs for trade tapes: clean trades, bars, features, checks, streams."""
