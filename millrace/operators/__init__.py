"""DataFrame operators: deduplication, overlap, sampling, pairing, expectations, time joins."""
