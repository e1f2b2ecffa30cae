from seasonspark.plans import axes, catalog, forecasts, pipelines  # noqa: F401  registers the queries
