from feedlake.plans import catalogue, service_queries  # noqa: F401  (the second registers with the first)
