"""Column functions: tokenizers, counters, predicates, fingerprints."""
