"""What users ask for: index, sync, query, impact, explain, status, sample."""
