"""Column helpers with the missing-value rules that all operators share."""
