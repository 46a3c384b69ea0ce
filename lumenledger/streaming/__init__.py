"""The job queue as a stream of micro-batches."""
