"""DataFrame operators: chunking, ranking, budgets, traversal, clustering."""
