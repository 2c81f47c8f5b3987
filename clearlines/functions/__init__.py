"""Column functions: text in, text or number out, all evaluated by Spark itself."""
