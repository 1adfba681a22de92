"""Forecasters and searches that run over many series in one Spark job."""
