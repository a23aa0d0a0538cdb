"""Telling faults of the data from faults of the cluster."""

from pyspark.errors import PySparkException

#: Java classes of errors that an expression raises over a value; running again would not help.
_DATA_FAULTS = (
    "org.apache.spark.SparkRuntimeException",
    "org.apache.spark.SparkArithmeticException",
    "org.apache.spark.SparkArrayIndexOutOfBoundsException",
    "org.apache.spark.SparkDateTimeException",
    "org.apache.spark.SparkIllegalArgumentException",
    "org.apache.spark.SparkNumberFormatException",
    "org.apache.spark.SparkNoSuchElementException",
    "org.apache.spark.SparkUnsupportedOperationException",
    "org.apache.spark.api.python.PythonException",
    "org.apache.spark.sql.catalyst.ExtendedAnalysisException",
    "org.apache.spark.sql.AnalysisException",
    "java.lang.ArithmeticException",
    "java.lang.NumberFormatException",
    "java.time.DateTimeException",
)


def data_fault(error: Exception) -> str | None:
    """First line of what went wrong over a value; None for any other error, such as a lost executor."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None:
        if cause.getClass().getName() in _DATA_FAULTS:
            return (cause.getMessage() or str(error)).splitlines()[0]
        cause = cause.getCause()
    if isinstance(error, PySparkException) and getattr(error, "_origin", None) is None:
        return str(error).splitlines()[0]
    return None

