"""Operators for training-data pipelines over tables of text and vectors.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; intermediate tables go to the folder that the cluster names
in ``spark.checkpoint.dir`` (see :mod:`pixelmill.llm.storage`).
"""
