"""How reports are put together: parameters, shared aggregates, ranking, packing."""
