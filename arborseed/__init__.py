"""arborseed: seed sketches, tree placement and mixture analysis of genome collections on Spark."""
