"""Column functions; nothing here runs Python per row unless it says so."""
