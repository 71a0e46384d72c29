"""Where task tables come from."""
