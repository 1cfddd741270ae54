"""Column expressions and session helpers shared by every operator."""
