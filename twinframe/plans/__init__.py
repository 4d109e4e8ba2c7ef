"""Entity views over the base tables, and the registered queries."""
