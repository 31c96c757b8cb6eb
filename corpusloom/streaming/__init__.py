"""Part of corpusloom: streaming."""
