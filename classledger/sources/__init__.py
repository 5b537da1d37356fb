"""Readers and writers: sheet batches, table snapshots, and views over the driver's tables."""
