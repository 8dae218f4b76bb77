"""Knowledge-graph inference, belief revision, similarity and conversation analytics as Spark DataFrame operators."""
