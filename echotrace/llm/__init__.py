"""Training-data operators: each module holds one operator, its query and its SQL where SQL can express it."""
