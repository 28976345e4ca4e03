"""Table catalog, bulk-unload files, control files, file listing and the audit store."""
