"""Reading recordings and reading/writing result tables."""
