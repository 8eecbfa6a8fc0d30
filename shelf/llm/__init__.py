"""Training-data operators: ten large-corpus components and the pipeline over them."""
