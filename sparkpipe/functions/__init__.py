"""What each expression function means in Spark columns."""
