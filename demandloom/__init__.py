"""Retail demand panels, forecast evaluation and replenishment as Spark DataFrame jobs."""
