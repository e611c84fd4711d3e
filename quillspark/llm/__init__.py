"""Operators for building training data from a corpus of documents.

Every operator takes and returns DataFrames.  Where a task needs numpy, Spark
partitions and shuffles the work and each task holds a bounded slice of it.
"""
