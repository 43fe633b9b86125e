"""edgeloom: a monthly, typed relation graph between organizations, built and checked on Spark."""
