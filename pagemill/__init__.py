"""pagemill: captured documentation pages to Markdown, links and reports, as Spark jobs."""
