"""Column expressions: windows with minimum counts, returns, scalar rules of the risk stack."""
