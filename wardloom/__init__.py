"""Ward rolls, field tallies and catalogues as Spark DataFrame jobs."""
