"""DataFrame operators: matching, spans, windows, trees, vectors, metrics, graphs."""
