"""From query texts to plans: the boolean query language and the search engine's interface."""
