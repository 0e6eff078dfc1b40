"""sessionloom - session analytics as plain ``DataFrame -> DataFrame`` steps on Spark.

Every step is built from Spark SQL expressions and is meant for ``df.transform``.
"""
