"""DataFrame operators: records, chunks, splits, epochs, selection, negatives, batches, mixing, metrics."""
