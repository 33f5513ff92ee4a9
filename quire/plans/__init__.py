"""Planning helpers: durable intermediate tables and whole pipelines."""
