"""DataFrame-in, DataFrame-out steps of the engagement analysis."""
