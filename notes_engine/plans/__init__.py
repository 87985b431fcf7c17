"""Plans: the domain tables derived from the test tables."""
