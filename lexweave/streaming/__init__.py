"""streaming of lexweave."""
