"""Extensions over unbounded inputs; the studies themselves are bounded."""
