"""loomframe: chart-data shaping, dataset curation and evaluation as Spark jobs."""
