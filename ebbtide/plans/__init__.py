"""Plan-level pieces: the materialised retention tables and plan inspection."""
