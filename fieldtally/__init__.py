"""fieldtally: reusable Spark table operators and the analytics recipes built from them."""
