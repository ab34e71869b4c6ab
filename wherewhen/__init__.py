"""Where things are, in which frame, at which instant: analytics over pose observations, on Spark."""
