"""Plans of folioforge."""
