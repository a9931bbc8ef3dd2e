"""Training-data operators: ten corpus operations over text tables, each as Spark jobs."""
