"""Part of corpusloom: sources."""
