"""DataFrame-to-DataFrame operators: provenance, intervals, dedup, windows, aggregates, resolution, graphs."""
