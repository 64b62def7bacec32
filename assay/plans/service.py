"""The guarded query service: repairs a statement, checks that it only reads, runs it with a deadline and a row cap, and names what went wrong."""

from __future__ import annotations

import difflib
import re
import threading
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat
from ..operators.compare import EMPTY, set_signature, signature
from ..sources.catalog import register, table

#: Words that no statement may hold outside of quotes.
FORBIDDEN = ("pragma", "attach", "detach", "insert", "update", "delete", "drop", "create", "alter")
#: Words no statement can end with; Spark would take some of them for an alias.
UNFINISHED = ("select", "from", "where", "and", "or", "on", "join", "inner", "left", "group", "order", "by", "having", "limit", "distinct", "as", "in", "not", "is", "like", "between", "union", "except", "intersect")
#: Fixed value: results that are kept, first in first out.
MEMO = 8192
#: Spark's error conditions and the service's codes for them.
CODES = {
    "TABLE_OR_VIEW_NOT_FOUND": "table_not_found", "UNRESOLVED_COLUMN": "column_not_found", "PARSE_SYNTAX_ERROR": "syntax_error", "AMBIGUOUS_REFERENCE": "ambiguous_column",
    "UNRESOLVED_ROUTINE": "sql_error", "MISSING_AGGREGATION": "sql_error", "MISSING_GROUP_BY": "sql_error", "DIVIDE_BY_ZERO": "sql_error",
}


def match_column(wanted: str, columns: list[str]) -> str | None:
    """The column meant: the same without case, with '_', '-' and blank alike, without them, else the most similar of enough similarity; null for none."""
    wanted = wanted.strip().strip('`"[]')
    for form in (str.lower, lambda s: re.sub("[-_ ]", " ", s.lower()).strip(), lambda s: re.sub("[-_ ]", "", s.lower())):
        for c in columns:
            if wanted and form(c) == form(wanted):
                return c
    close = difflib.get_close_matches(wanted.lower(), [c.lower() for c in columns], n=1, cutoff=0.6 if len(wanted) <= 4 else 0.75) if wanted else []
    return next((c for c in columns if close and c.lower() == close[0]), None)


def repair_columns(sql: str, columns: list[str]) -> str:
    """Names written with '_' for the '-' or blank of a real column become that column, outside of quotes."""
    meant = {re.sub("[- ]", "_", c).lower(): c for c in columns if re.search("[- ]", c)}
    return "".join(f"`{meant[t.lower()]}`" if t.lower() in meant else t for t in compat.tokens(sql)) if meant else sql


class QueryService:
    """Read-only queries over the tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str, tables: list[str] | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.tables = register(spark, folder, tables)
        self.columns = {t: table(spark, folder, t).columns for t in self.tables}
        compat.register_functions(spark)
        types: dict[str, set[str]] = defaultdict(set)
        for t in self.tables:
            for f in table(spark, folder, t).schema.fields:
                types[f.name.lower()].add(f.dataType.typeName())
        self.text_columns = {c for c, kinds in types.items() if kinds == {"string"}}
        self._ran: dict[tuple[str, int], dict] = {}
        self._gold: dict[str, tuple] = {}
        self._lock = threading.Lock()

    def check(self, sql: str) -> str:
        """The statement as it will run; raises ValueError if it isn't a single reading one."""
        text = re.sub(r"[?!]+\s*$", "", re.sub(r"\\(?![%_'])", "", sql.replace('\\"', "'")))
        known = {c for cs in self.columns.values() for c in cs}
        text = repair_columns(compat.rewrite(text, known, self.text_columns), sorted(known))
        plain = [t.lower() for t in compat.tokens(text) if t[0] not in "'\"`" and not t.isspace()]
        if not plain or plain[0] not in ("select", "with", "("):
            raise ValueError("only SELECT and WITH statements")
        if ";" in plain or any(w in FORBIDDEN for w in plain):
            raise ValueError("a statement that writes, or more than one")
        if plain[-1] in UNFINISHED:
            raise SyntaxError(f"the statement ends with {plain[-1]}")
        return text

    def frame(self, sql: str) -> DataFrame:
        """The statement's result; bare columns beside aggregates stand for a value of their group. Raises ValueError if its parsed plan is no query."""
        text = self.check(sql)
        parsed = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        if re.search(r"Command|Insert|Create|Replace|Drop|Alter|Truncate|MergeInto|SetCatalog|UseNamespace", parsed.getClass().getSimpleName()):
            raise ValueError("not a query")
        for _ in range(16):
            try:
                return self.spark.sql(text)
            except PySparkException as e:
                condition = (e.getCondition() or "").split(".")[0]
                names = re.findall(r'"([^"]+)"', " ".join(map(str, (e.getMessageParameters() or {}).values()))) if condition in ("MISSING_AGGREGATION", "MISSING_GROUP_BY", "UNRESOLVED_COLUMN") else []
                if condition == "MISSING_GROUP_BY":  # the message names no column: each bare one is tried
                    names = [c for cs in self.columns.values() for c in cs if re.search(rf"\b{re.escape(c)}\b", text, re.I)]
                again = next((x for x in (compat.with_bare_column(text, n) for n in names) if x is not None), None) if condition != "UNRESOLVED_COLUMN" else None
                if again is None:
                    raise
                text = again
        return self.spark.sql(text)

    def query(self, sql: str, max_rows: int = 100, timeout_s: float = 45.0) -> dict:
        """rows, columns and truncated (whether max_rows were reached), and warnings; or an error with its code. The last MEMO different
        texts are run once; one that ran out of time is run again."""
        key = (sql, max_rows)
        with self._lock:
            if key in self._ran:
                return self._ran[key]
        result = self._run(sql, max_rows, timeout_s)
        if result.get("error") != "timeout":
            with self._lock:
                self._ran[key] = result
                while len(self._ran) > MEMO:
                    del self._ran[next(iter(self._ran))]
        return result

    @contextmanager
    def deadline(self, timeout_s: float):
        """Jobs started inside are cancelled after timeout_s; gives an event that tells whether they were."""
        sc, group, late = self.spark.sparkContext, uuid.uuid4().hex, threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(timeout_s, stop)
        sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
        timer.start()
        try:
            yield late
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def _run(self, sql: str, max_rows: int, timeout_s: float) -> dict:
        try:
            text = self.check(sql)
        except ValueError as e:
            return {"error": "invalid_sql", "message": str(e)}
        except SyntaxError as e:
            return {"error": "syntax_error", "message": str(e)}
        with self.deadline(timeout_s) as late:
            try:
                df = self.frame(sql)
                rows = [list(r) for r in df.limit(max_rows).collect()]
            except ValueError as e:
                return {"error": "invalid_sql", "message": str(e)}
            except (PySparkException, Py4JJavaError) as e:
                out = self.failure(e, late)
                if out["error"] == "column_not_found":
                    out["valid_columns"] = {t: c for t, c in self.columns.items() if re.search(rf"\b{re.escape(t)}\b", sql)}
                return out
        out = {"columns": df.columns, "rows": rows, "truncated": len(rows) >= max_rows}
        if text != sql:
            out["corrected_sql"] = text
        cells = [c for r in rows for c in r]
        if not rows:
            out["warning"] = "no rows"
        elif cells == [0]:
            out["warning"] = "a single zero"
        elif all(c is None for c in cells):
            out["warning"] = "only nulls"
        return out

    @staticmethod
    def failure(e: Exception, late: threading.Event) -> dict:
        """An error's code and first line."""
        condition = ((e.getCondition() if isinstance(e, PySparkException) else "") or "").split(".")[0]
        if not condition and "PARSE" in str(e)[:300]:
            condition = "PARSE_SYNTAX_ERROR"
        return {"error": "timeout" if late.is_set() else CODES.get(condition, "sql_error" if condition else "unexpected_error"), "message": str(e).split("\n")[0][:300]}

    def consensus(self, statements: list[str], max_rows: int = 100, workers: int = 4) -> dict:
        """Runs every different statement once; the largest group of same columns and ordered rows wins, ties by the earliest statement."""
        with ThreadPoolExecutor(workers) as pool:
            results = dict(zip(dict.fromkeys(statements), pool.map(lambda s: self.query(s, max_rows), dict.fromkeys(statements))))
        groups: dict[str, list[int]] = defaultdict(list)
        for i, s in enumerate(statements):
            if "error" not in (r := results[s]):
                groups[signature([tuple(x) for x in r["rows"]], r["columns"])].append(i)
        order = sorted(groups.values(), key=lambda g: (-len(g), g[0]))
        member = [-1] * len(statements)
        for rank, group in enumerate(order):
            for i in group:
                member[i] = rank
        if not order:
            return {"error": "no statement ran", "membership": member}
        return {"winner": order[0][0], "votes": len(order[0]), "membership": member, "result": results[statements[order[0][0]]]}

    def peek(self, name: str, columns: list[str], k: int = 10, where: str = "") -> DataFrame:
        """The profile of a table's columns, whose names may be slightly wrong, over the rows that meet where."""
        from ..operators.profile import column_profile

        if name not in self.columns:
            raise ValueError(f"no table {name}")
        real = [match_column(c, self.columns[name]) for c in columns]
        if None in real:
            raise ValueError(f"no column {columns[real.index(None)]} in {name}; it has {', '.join(self.columns[name])}")
        return column_profile(compat.where_fragment(table(self.spark, self.folder, name), where), list(dict.fromkeys(real)))

    def compared(self, pred_sql: str | None, gold_sql: str | None, timeout_s: float = 60.0) -> dict:
        """ran, gold_ran, equal and status of one pair: 'ok', or what failed on which side. Each side has the whole deadline."""
        sides: dict[str, DataFrame | None] = {}
        errors: dict[str, str] = {}
        for side, text in (("gold", gold_sql), ("pred", pred_sql)):
            with self.deadline(timeout_s) as late:
                try:
                    sides[side] = self._results(text or "") if side == "gold" else self._rows(text or "")
                except (ValueError, SyntaxError) as e:
                    errors[side] = str(e)
                except (PySparkException, Py4JJavaError) as e:
                    errors[side] = "timeout" if late.is_set() else self.failure(e, late)["message"]
        equal = not errors and same_rows(sides["pred"], sides["gold"])
        status = "; ".join(f"{side}_error: {errors[side]}" for side in ("pred", "gold") if side in errors) or "ok"
        return {"ran": "pred" not in errors, "gold_ran": "gold" not in errors, "equal": equal, "status": status}

    def _rows(self, text: str) -> tuple[int, str]:
        """A statement's width and the signature of its set of rows; the rows stay where they are."""
        df = self.frame(text)
        return len(df.columns), set_signature(df).first()["signature"]

    def _results(self, text: str) -> tuple[int, str]:
        """The same of a reference statement, which is run once for all its predictions; the last MEMO are kept, failures too."""
        with self._lock:
            kept = self._gold.get(text)
        if kept is None:
            try:
                kept = (self._rows(text), None)
            except (ValueError, SyntaxError, PySparkException, Py4JJavaError) as e:
                kept = (None, e)
            with self._lock:
                self._gold[text] = kept
                while len(self._gold) > MEMO:
                    del self._gold[next(iter(self._gold))]
        if kept[1] is not None:
            raise kept[1]
        return kept[0]

    def evaluate(self, pairs: DataFrame, max_pairs: int = 100_000, workers: int = 4, timeout_s: float = 60.0) -> DataFrame:
        """pairs (id, pred_sql, gold_sql) with ran, gold_ran, equal and status: different pairs are run once, from the driver, as text in rows can't be
        run in a task; each has a deadline. Two results are equal as sets of rows; more than max_pairs different pairs are refused."""
        each = pairs.select("pred_sql", "gold_sql").distinct().limit(max_pairs + 1).collect()
        if len(each) > max_pairs:
            raise ValueError(f"over {max_pairs} different pairs; split them")

        def run(row) -> tuple:
            r = self.compared(row["pred_sql"], row["gold_sql"], timeout_s)
            return row["pred_sql"], row["gold_sql"], r["ran"], r["gold_ran"], r["equal"], r["status"]

        with ThreadPoolExecutor(workers) as pool:
            done = list(pool.map(run, sorted(each, key=lambda r: r["gold_sql"] or "")))
        result = self.spark.createDataFrame(done, "p string, g string, ran boolean, gold_ran boolean, equal boolean, status string")
        return pairs.join(result, F.col("pred_sql").eqNullSafe(F.col("p")) & F.col("gold_sql").eqNullSafe(F.col("g"))).drop("p", "g")


def same_rows(a: tuple[int, str], b: tuple[int, str]) -> bool:
    """Whether two results of _rows are the same set; two empty ones are, whatever their widths."""
    return a == b or a[1] == b[1] == EMPTY
