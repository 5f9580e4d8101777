"""Ad-hoc SQL over a selection of visits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row

from visitflow.operators import catalog
from visitflow.sources.files import register


@dataclass
class SqlResult:
    """A lazy result, or the text of the error; both None for blank input.

    Everything that runs the query does so under ``tag``, by which :meth:`cancel` ends it from another thread.
    """

    data: DataFrame | None = None
    error: str | None = None
    tag: str = field(default_factory=lambda: f"visitflow-{uuid4().hex}")
    cancelled: bool = False

    def execute(self) -> list[Row]:
        """All rows at once, for results known to be small (see :meth:`pages` for others).

        An error while the query runs becomes ``error`` and gives no rows.
        """
        return self._run(lambda data: data.collect(), [])

    def pages(self, size: int = 1000) -> Iterator[list[Row]]:
        """The rows in their order, ``size`` at a time.

        One partition of the result is fetched at a time and only as far as pages are asked for. An error while the query
        runs becomes ``error`` and ends the pages.
        """
        page: list[Row] = []
        try:
            if self.data is not None:
                with self._tagged():  # the fetching thread starts here and keeps the tag
                    rows = self.data.toLocalIterator()
                for row in rows:
                    page.append(row)
                    if len(page) == size:
                        yield page
                        page = []
        except (PySparkException, Py4JJavaError) as error:
            self._failed(error)
        except Exception as error:  # a fetch that the other side has ended
            if not self.cancelled:
                raise
            self._failed(error)
        if page and self.error is None:
            yield page

    def rows(self) -> int:
        """Number of result rows (runs the query); an error while it runs becomes ``error``."""
        return self._run(lambda data: data.count(), 0)

    def cancel(self) -> None:
        """End what runs for this result; its reader finds the reason in ``error``."""
        self.cancelled = True
        if self.data is not None:
            self.data.sparkSession.sparkContext.cancelJobsWithTag(self.tag)

    @contextmanager
    def _tagged(self):
        context = self.data.sparkSession.sparkContext
        context.addJobTag(self.tag)
        try:
            yield
        finally:
            context.removeJobTag(self.tag)

    def _failed(self, error: Exception) -> None:
        self.data, self.error = None, f"cancelled: {error}" if self.cancelled else str(error)

    def _run(self, action, nothing):
        if self.data is None:
            return nothing
        try:
            with self._tagged():
                return action(self.data)
        except (PySparkException, Py4JJavaError) as error:
            self._failed(error)
            return nothing


def run_sql(visits: DataFrame, text: str) -> SqlResult:
    """Run one query (Spark SQL) against the table ``patients``, the given visits. No data is copied.

    The text is read as a subquery, so statements that change anything are syntax errors, and the name ``patients``
    belongs to this call alone: its view has a name of its own and is gone when the query is analysed.
    """
    query = re.sub(r"[\s;]+$", "", text)
    if not query.strip():
        return SqlResult()
    spark, view = visits.sparkSession, f"patients_{uuid4().hex}"
    register(visits, view)
    try:
        return SqlResult(data=spark.sql(f"WITH patients AS (SELECT * FROM {view}) SELECT * FROM (\n{query}\n)"))
    except PySparkException as error:
        return SqlResult(error=str(error))
    finally:
        spark.catalog.dropTempView(view)


def preset(visits: DataFrame, name: str) -> DataFrame:
    """One of the ready-made queries, by its display name."""
    return catalog.PRESETS[name](visits)


def report_queries(visits: DataFrame) -> dict[str, DataFrame]:
    """The queries of the statistical report: name to lazy result."""
    return {name: query(visits) for name, query in catalog.REPORT.items()}
