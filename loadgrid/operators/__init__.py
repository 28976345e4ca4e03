"""Relational operators shared by the datasets and the driver-table queries."""
