"""DataFrame operators: filters, joins, caps, aggregates, sets, orders."""
