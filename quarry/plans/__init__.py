"""From a search string to a typed plan."""
