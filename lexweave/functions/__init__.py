"""functions of lexweave."""
