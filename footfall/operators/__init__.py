"""DataFrame operators: the same functions serve batch tables and micro-batches."""
