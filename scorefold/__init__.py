"""Scorefold: evaluation analytics over panels, event tables and paired response logs, written as Spark DataFrame functions."""
