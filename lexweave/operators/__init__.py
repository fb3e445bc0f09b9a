"""operators of lexweave."""
