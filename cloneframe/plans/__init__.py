"""The registered queries: stand-in clone tables over the driver tables, and the SQL of each query."""
