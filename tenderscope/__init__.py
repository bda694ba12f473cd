"""Procurement-market analytics and call-to-expert matching as Spark jobs."""
