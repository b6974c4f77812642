"""silomesh: a PySpark-native engine over collections of many small relational databases ("silos")."""

__version__ = "0.1.0"
