"""Package functions of threadloom."""
