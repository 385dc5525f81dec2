"""Driver-side plans: parameters, the report job, and skew-safe group helpers."""
