"""DataFrame operators: profiling, sketches, joins, aggregation, association, preparation, perturbation."""
