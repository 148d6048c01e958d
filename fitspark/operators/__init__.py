"""DataFrame operators: facts, components and scores of candidates, rankings, metrics, matching and repair."""
