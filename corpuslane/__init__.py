"""corpuslane: document retrieval and text analytics as Spark DataFrame operators."""
