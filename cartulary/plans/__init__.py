"""Plans of actions: tags, renames, coverage."""
