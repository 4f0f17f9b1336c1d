"""Plans: explanation with placement, statistics and the access-path advisor."""
