"""Multi-step studies and Spark ML ensembles."""
