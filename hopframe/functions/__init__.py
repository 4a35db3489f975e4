"""Column-level building blocks; all of them stay inside the JVM except the
two Arrow helpers in ``sequence`` and ``stemming``."""
