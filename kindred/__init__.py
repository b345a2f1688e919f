"""kindred: interaction analytics and item recommendations as Spark jobs."""
