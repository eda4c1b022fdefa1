"""Patient sequences from longitudinal health records, as Spark jobs."""
