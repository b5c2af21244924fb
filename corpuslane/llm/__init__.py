"""Training-data operators: each module is one operator, ``registered`` holds their queries."""
