"""Sources: CSV, JSON and XML files and stored tables as all-string tables."""
