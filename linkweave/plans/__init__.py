from linkweave.plans import lookups  # noqa: F401 (registers its queries)
