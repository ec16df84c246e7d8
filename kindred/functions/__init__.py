"""Column functions: cleaning, string similarity, vector arithmetic."""
