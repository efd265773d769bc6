"""Training-data operators. Each module holds one operator, its query and, where SQL can say it, its SQL."""
