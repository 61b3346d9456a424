"""Pathloom: search, de-duplication and evaluation of agent trajectories as Spark plans."""
