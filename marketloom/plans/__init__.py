"""Table bindings, the query registry, and the queries of each area."""
