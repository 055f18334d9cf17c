"""End-to-end queries: analysis, evaluation, detection, reduction statistics, model search."""
