"""tessera: relational code-and-corpus analytics as DataFrame-to-DataFrame operators on Spark."""
