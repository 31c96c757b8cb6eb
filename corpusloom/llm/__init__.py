"""Operators for preparing training data; nothing else in corpusloom imports this subpackage."""
