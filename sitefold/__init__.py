"""sitefold: landed web pages, sitemaps and URL lists to clean tables, on Spark."""
