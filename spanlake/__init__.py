"""spanlake: passage retrieval, corpus networks and cited outlines as Spark jobs."""
