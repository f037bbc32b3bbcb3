"""spanforge: interval, segmentation, signal, text and ledger analytics as PySpark DataFrame transforms."""
