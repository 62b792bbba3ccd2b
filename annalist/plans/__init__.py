"""Views of the driver tables, named queries, and the SQL they must agree with."""
