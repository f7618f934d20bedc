"""Training-data operators: ten corpus-scale steps, each built on Spark jobs."""
