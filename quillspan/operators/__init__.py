"""General data-processing operators (snapshot diff, intervals, history, packed values)."""
