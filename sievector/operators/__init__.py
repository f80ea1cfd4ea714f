"""Search, evaluation, encoding, profiling and graph operators."""
