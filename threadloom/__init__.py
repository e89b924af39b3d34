"""Entity-network analytics on Spark: reports and call records in, graph answers out."""
