"""Corpus operators for training data: dedup, packing, scans, fingerprints and token output.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames; Python runs
only inside tasks, on Arrow batches. Cut points are Parquet tables written to the folder that the session names
in ``spark.checkpoint.dir``.
"""
