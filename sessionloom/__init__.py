"""Task models from recorded computer-use sessions, as Spark DataFrame jobs."""
