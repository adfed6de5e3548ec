"""Limit-order-book analytics and corpus preparation as Spark jobs."""
