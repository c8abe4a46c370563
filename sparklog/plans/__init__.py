"""Plan shapes that keep operators to equi-joins and partitioned windows."""
