"""Numbers and expressions that the operators share."""
