"""codeloom: a code-intelligence graph engine expressed as Spark DataFrame jobs."""
