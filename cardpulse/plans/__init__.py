"""Feature registry and planner, layer builds, and the registered queries."""
