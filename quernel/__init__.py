"""Behavioural analytics on PySpark: features, clustering, evaluation, exploration."""
