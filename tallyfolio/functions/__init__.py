"""Column functions: text cleaning, naming, prompts and evidence."""
