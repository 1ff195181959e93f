"""Part of folioscan; see the README for the layout."""
