"""Query plans over the data tables."""
