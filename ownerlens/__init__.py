"""Corporate-ownership intelligence as Spark DataFrame operators."""
