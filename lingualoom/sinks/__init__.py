"""Writers: rebuilt documents, reports, runs and baselines."""
