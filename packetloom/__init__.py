"""Network-traffic security analytics on Spark: preparation, features, scoring, correlation, sessions."""
