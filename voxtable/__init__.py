"""Analytics over collections of spoken recordings, as Spark DataFrame operators."""
