"""Sources: raw JSON and text into typed tables."""
