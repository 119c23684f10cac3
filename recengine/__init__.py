"""recengine: recommender-system data pipelines as Spark DataFrame operators."""
