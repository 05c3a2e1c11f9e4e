"""Where pages, questions and replies come from, and where results go."""
