"""Text evidence over corpora, as Spark jobs."""
