"""DataFrame operators: detectors, joins, aggregations, ranking and triage."""
