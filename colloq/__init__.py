"""Turn-taking training data from multi-party conversations, as Spark plans."""
