"""Streaming.

The source system has no streaming, watermarks or stateful operators, so this package adds no
operator of its own.  The stateless operators (``normalize_table``, the filters, ``convert_*``
and z-score / IQR scoring with precomputed statistics) are projections and filters, so they
apply unchanged to a DataFrame from ``spark.readStream``; ``tests/test_streaming.py`` runs them
on a file stream.
"""
