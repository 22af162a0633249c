"""graphloom: analytics over versioned, typed property graphs, on Spark."""
