"""Preparation of data-classification datasets on Spark."""
