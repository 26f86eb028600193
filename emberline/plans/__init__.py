"""Registered queries. Importing a module of this package registers its queries."""
