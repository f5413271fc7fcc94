"""A lakehouse table engine whose row work is Spark's: tables, snapshots, deletes, SQL."""
