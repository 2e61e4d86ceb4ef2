"""Behaviour analytics over clickstream tables and ad click logs, as Spark jobs."""
