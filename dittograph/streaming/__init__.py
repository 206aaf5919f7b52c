"""Groups that grow as files arrive."""
