"""Dataset builders, run modes and the driver-table queries."""
