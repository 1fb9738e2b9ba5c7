"""Physical-plan helpers: size-checked broadcast, lineage cuts, plan checks."""
