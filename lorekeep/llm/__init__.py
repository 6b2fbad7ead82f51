"""Training-data operators: ten corpus steps that stand beside the retrieval engine."""
