"""DataFrame operators: files, links, cohesion, rules, statistics, listings."""
