"""The engine: scripts in, result envelopes out; errors are values."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources import files, layout
from sparkloom.sources.catalog import Catalog
from sparkloom.sql import translate
from sparkloom.sql.parser import ParseError, Parser, parse, split_statements
from sparkloom.sql.validator import check

LONGEST_SCRIPT = 10_000


@dataclass
class Result:
    success: bool = False
    result: Any = None
    parsed_query: Any = None
    execution_time_ms: float = 0.0
    errors: list[str] = field(default_factory=list)
    all_results: list["Result"] = field(default_factory=list)

    @property
    def queries_executed(self) -> int:
        return len(self.all_results) or 1

    def collect(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.result.collect()] if isinstance(self.result, DataFrame) else []


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.catalog = spark, Catalog(spark, root)
        self.history: list[dict] = []
        self.operations: list[str] = []

    def execute_sql(self, text: str, validate: bool = True) -> Result:
        """Runs a script; a missing last semicolon is added. Later statements run after an error; the result is the last that is not null."""
        if not text.strip() or len(text) > LONGEST_SCRIPT:
            return Result(errors=[f"a script has 1 to {LONGEST_SCRIPT} characters"])
        try:
            statements = split_statements(text if text.rstrip().endswith(";") else text + "\n;")
        except ParseError as e:
            return Result(errors=[f"parse error: {e}"])
        each = [self._one(tokens, validate) for tokens in statements]
        if len(each) == 1:
            return each[0]
        last = next((r for r in reversed(each) if r.result is not None), None)
        return Result(all(r.success for r in each), last.result if last else None, [r.parsed_query for r in each], sum(r.execution_time_ms for r in each), [e for r in each for e in r.errors], each)

    def _one(self, tokens: list, validate: bool) -> Result:
        out, began = Result(), time.time()
        sql = " ".join(t.value for t in tokens)
        try:
            out.parsed_query = Parser(tokens).statement()
            out.errors = check(out.parsed_query, {n: t.columns for n, t in self.catalog.tables.items()}) if validate else []
            if not out.errors:
                self.operations.append(translate.operation(out.parsed_query))
                out.result = translate.execute(self.catalog, out.parsed_query)
                out.success = True
        except ParseError as e:
            out.errors = [f"parse error: {e}"]
        except Exception as e:  # noqa: BLE001  errors are values here
            out.errors = [f"error: {e}"]
        if out.parsed_query is not None:
            self.history.append({"sql": sql, "success": out.success, "timestamp": began})
        out.execution_time_ms = (time.time() - began) * 1000
        return out

    def parse_only(self, text: str) -> tuple[bool, Any]:
        try:
            return True, parse(text)
        except ParseError as e:
            return False, str(e)

    def validate_only(self, text: str) -> tuple[bool, list[str]]:
        ok, query = self.parse_only(text)
        errors = check(query, {n: t.columns for n, t in self.catalog.tables.items()}) if ok else [query]
        return not errors, errors

    def list_tables(self) -> list[str]:
        return list(self.catalog.tables)

    def get_table_info(self, name: str) -> dict | None:
        return self.catalog.info(name) if name in self.catalog.tables else None

    def get_query_history(self, n: int | None = None) -> list[dict]:
        return self.history[-n:] if n else list(self.history)

    def clear_history(self) -> None:
        self.history.clear()

    def get_operations_log(self) -> list[str]:
        return list(self.operations)

    def status(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "tables": len(self.catalog.tables), "structures": dict(layout.DESCRIPTIONS)}

    def load_csv(self, name: str, path: str, key: str | None = None, index: str | None = None, blanks_as_zero: bool = True) -> dict:
        """A table from a CSV file: rows that came in, and up to ten that could not be read."""
        columns = files.csv_columns(self.spark, path, key, index)
        good, bad = files.read_csv(self.spark, path, columns, blanks_as_zero)
        self.catalog.create(name, columns)
        return {"inserted": self.catalog.append(name, good), "errors": [r.asDict() for r in bad.limit(10).collect()]}

    def preview(self, name: str, limit: int = 100) -> dict:
        rows, more = self.catalog.preview(name, limit)
        return {"rows": [r.asDict(recursive=True) for r in rows.collect()], "truncated": more}

    def drop_table(self, name: str) -> bool:
        return self.catalog.drop(name)

    def to_dict(self, result: Result) -> dict:
        return asdict(Result(result.success, None, None, result.execution_time_ms, result.errors)) | {"result": result.collect() or result.result}
