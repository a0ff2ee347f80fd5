"""Data jobs: ordering, cleaning, profiling, distributions, associations, charts."""
