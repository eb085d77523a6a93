"""Package sources of threadloom."""
