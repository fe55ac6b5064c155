"""Evidence analytics on Spark: DataFrame operators over observations, documents, payments, graphs and feeds."""
