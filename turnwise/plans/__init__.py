"""End-to-end plans: from files to published tables."""
