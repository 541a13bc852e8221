"""Jobs: the operators put together, from stored input to stored results."""
