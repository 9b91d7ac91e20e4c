"""Plans: the cell pass, keyed rules, row positions and whole validation runs."""
