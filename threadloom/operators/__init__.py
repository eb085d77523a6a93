"""Package operators of threadloom."""
