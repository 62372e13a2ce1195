"""Passageworks: ranked passage search and text analytics as Spark plans."""
