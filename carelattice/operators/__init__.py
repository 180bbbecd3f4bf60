"""DataFrame operators: listings, joins, search, splitting, quality rules and state machines."""
