"""Views over the provided tables, registered queries and their SQL twins."""
