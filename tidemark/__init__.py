"""tidemark: event-catalogue analytics and corpus preparation as PySpark jobs."""
