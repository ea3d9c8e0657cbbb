"""Where vectors come from and where compressed ones go."""
