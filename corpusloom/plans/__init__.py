"""Part of corpusloom: plans."""
