"""A relational query engine on Spark: typed tables, SQL statements, snapshots."""
