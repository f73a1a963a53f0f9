"""Where rows come from and go to: literal rows, run-scoped Parquet, shared storage."""
