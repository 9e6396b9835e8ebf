"""pairloom: matching, ranking and evaluating text documents against postings, as Spark DataFrame jobs."""
