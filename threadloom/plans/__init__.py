"""Package plans of threadloom."""
