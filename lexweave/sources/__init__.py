"""sources of lexweave."""
