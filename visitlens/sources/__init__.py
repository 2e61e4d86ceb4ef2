"""Readers: action, user, product and task tables, ad click lines, JDBC."""
