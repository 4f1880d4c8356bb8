"""Remote invocation as a table function: every call gives a row of success, result and error, never an exception."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def exported(methods: dict[str, Callable[[int], int]]):
    """A table function (method, argument) -> (ok, result, error) over the exported methods."""

    class Invoke:
        def eval(self, method: str, argument: int) -> Iterator[tuple]:
            try:
                yield True, methods[method](argument), None
            except KeyError:
                yield False, None, f"no method {method}"
            except Exception as e:
                yield False, None, f"{type(e).__name__}: {e}"

    return udtf(Invoke, returnType="ok boolean, result long, error string")


def register(spark: SparkSession, name: str, methods: dict[str, Callable[[int], int]]) -> None:
    spark.udtf.register(name, exported(methods))
