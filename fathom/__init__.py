"""fathom: search and analytics over collections of source files and documents, as Spark jobs."""
