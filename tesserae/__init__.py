"""Small-area incident analytics on Spark: panels, features, count models, evaluation and patrol allocation."""
