"""Training-data operators: one module per operator, all of them Spark jobs over `documents`."""
