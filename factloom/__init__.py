"""factloom: versioned-fact retrieval, arbitration and conflict analytics as Spark dataframes."""
