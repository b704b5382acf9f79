"""Analytics over collections of deeply nested records, as Spark DataFrame plans."""
