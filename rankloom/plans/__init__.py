"""The registered queries: one module per operator family, Spark plan and check SQL side by side."""
