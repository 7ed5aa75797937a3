"""Functions of folioforge."""
