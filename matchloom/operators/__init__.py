"""Operators: DataFrame in, DataFrame out, keyed by (tenant_id, job_id, candidate_id)."""
