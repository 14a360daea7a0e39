"""The engine in Spark SQL: native columns as SQL functions, and the fetch ladder as a table function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import contract as C
from . import text as X
from . import urls as U

#: Functions by name: the names and types of their parameters, the type that they return, and their column.
FUNCTIONS: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "host_key": ("url string", "string", U.host_key),
    "url_error": ("url string", "string", U.url_error),
    "urls_match": ("a string, b string", "boolean", U.urls_match),
    "content_type": ("header string", "string", C.content_type),
    "type_supported": ("kind string", "boolean", C.type_supported),
    "retry_status": ("status int", "boolean", C.retry_status),
    "visible_word_count": ("html string", "bigint", X.visible_word_count),
    "challenge_hit": ("html string", "boolean", X.challenge_hit),
    "weak_fetch": ("has_page boolean, status int, html string, words bigint, challenge boolean, need boolean", "boolean", C.weak_fetch),
}


def register(spark: SparkSession, prefix: str = "page_") -> list[str]:
    """Makes the functions known to the session as temporary SQL functions, which the optimizer puts into the query as the expressions that they are; and climb_ladder as a table function. Their names."""
    made = []
    for name, (params, returns, column) in FUNCTIONS.items():
        args = [p.split()[0] for p in params.split(", ")]
        kinds = spark.createDataFrame([], params)
        plan = kinds.select(column(*[F.col(a) for a in args]).alias("x"))._jdf.queryExecution().analyzed()
        body = plan.projectList().apply(0).child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(p.replace(' ', ' ', 1) for p in params.split(', '))}) RETURNS {returns} RETURN {body}")
        made.append(prefix + name)
    spark.udtf.register(f"{prefix}climb_ladder", ClimbLadder)
    return [*made, f"{prefix}climb_ladder"]


@udtf(returnType="request_id bigint, chosen bigint, used_browser boolean, reason string, mode_used string, failed boolean")
class ClimbLadder:
    """A request's attempts, partitioned by it and ordered by rung, to its page.

    Rows: request_id, mode, host_score, rung (0 to 4), page_id (null: nothing came),
    weak, auto_reason, http_reason. One row is held for each rung.
    """

    def __init__(self):
        self.rungs, self.asked = {}, None

    def eval(self, row) -> None:
        self.asked = (row["request_id"], row["mode"], row["host_score"] or 0)
        if row["rung"] is not None and row["page_id"] is not None:
            self.rungs[row["rung"]] = row

    def terminate(self):
        if self.asked is None:
            return
        request, mode, score = self.asked
        weak = lambda r: r is None or r["weak"] is not False
        last = self.rungs.get(4)
        if mode == "browser":
            yield request, last and last["page_id"], True, "none", "browser", weak(last)
            return
        forced = score >= 3
        page = self.rungs.get(0) if forced else None
        warm = page is not None
        for rung in (1, 2, 3):
            page = self.rungs.get(rung) if weak(page) else page
        if mode == "auto":
            reason = page["auto_reason"] if page is not None else "http_empty"
        else:
            reason = (page["http_reason"] if page is not None else "http_low_words") if weak(page) else None
        took = reason is not None and last is not None
        used, page = took or warm, last if took else page
        told = reason or ("http_blocked" if forced else None)
        yield request, page and page["page_id"], used, (told or "none") if used else "none", "browser" if used and mode == "auto" else mode, weak(page)
