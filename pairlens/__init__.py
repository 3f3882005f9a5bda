"""Text-pair analytics on Spark: features, graph, vectors, models and blending."""
