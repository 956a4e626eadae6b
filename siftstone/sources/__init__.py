"""Reading and writing: markdown folders, JSON and CSV, versioned tables."""
