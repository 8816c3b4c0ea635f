"""DataFrame -> DataFrame operators: star joins, statistics, ranking, reshape,
quality checks. Nothing here collects to the driver."""
