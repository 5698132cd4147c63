"""Table jobs on Spark: copy, reshape, load, browse, search, edit, compare,
snapshot and check tables as DataFrame jobs."""
