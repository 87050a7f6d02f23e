"""From a program to what is evaluated: types, rewrites and strata. Nothing here needs Spark."""
