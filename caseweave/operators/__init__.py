"""Building blocks of the queries: concept sets, groups of items, intervals, ranking, person tests."""
