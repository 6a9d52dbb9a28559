"""Grid-style analytics on Spark: requests, formulas and change streams compiled to Catalyst plans."""
