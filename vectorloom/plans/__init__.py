"""What is decided before a job runs: search options and plans, filter expressions."""
