"""DataFrame operators: outliers, attributes, issues, changes, decisions."""
