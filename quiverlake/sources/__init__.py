"""Sources, sinks and caches."""
