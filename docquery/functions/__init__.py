"""Column functions: cleaning, tokenising, scoring."""
