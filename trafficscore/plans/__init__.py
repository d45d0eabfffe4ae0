"""Join, cache and checkpoint strategies, jobs, views and registered queries."""
