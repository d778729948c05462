"""Schedule-shaped data on Spark: extraction, cleaning, quality, search and conversations as DataFrame jobs."""
