"""Review-text analytics as composable PySpark DataFrame jobs."""
