"""Dependency-upgrade analytics over a fleet of code repositories, as Spark jobs."""
