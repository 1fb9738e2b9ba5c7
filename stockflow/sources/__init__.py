"""Sources and sinks: table loading, seed fixture, test-table derivation."""
