"""workload."""
