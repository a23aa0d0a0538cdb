"""Table quality, profiling and dataset lineage as DataFrame-to-DataFrame functions."""
