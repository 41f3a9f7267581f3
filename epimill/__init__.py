"""epimill: daily-report analytics as column-parameterised Spark DataFrame operators."""

__version__ = "0.1.0"
