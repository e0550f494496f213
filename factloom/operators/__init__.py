"""DataFrame to DataFrame operators: joins, graphs, aggregates, budgets, rules."""
