"""DataFrame -> DataFrame operators (filters, aggregates, joins, scores)."""
