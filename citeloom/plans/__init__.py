"""Named queries over the driver tables, with SQL for the same."""
