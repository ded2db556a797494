"""Column functions: each takes and returns Columns, so all of them stay inside Catalyst."""
