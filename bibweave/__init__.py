"""bibweave: bibliographic reference checking and corpus preparation as Spark jobs."""
