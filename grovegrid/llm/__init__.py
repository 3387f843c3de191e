"""Training-data operators: one module each, with its query and, where SQL can say it, its oracle."""
