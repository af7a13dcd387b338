"""Where notes and settings come from and answers go."""
